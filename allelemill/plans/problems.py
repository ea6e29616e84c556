"""Queries of the general problems over the tables of a data folder, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import error_parse as E
from ..operators import orphans as O
from ..operators import packed as P
from ..operators import units as U
from ..tables import table


def _references(spark: SparkSession, d: str) -> DataFrame:
    a = O.reference_rows(table(spark, d, "sumstats"), "sumstats", "row_id", "rsid", "loaded_at")
    return a.unionByName(O.reference_rows(table(spark, d, "eqtl_stats"), "eqtl_stats", "eqtl_id", "rsid", "loaded_at"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    cols = [F.col("rsid").alias("key"), "added_at", "withdrawn_at", "merged_into"]
    return table(spark, d, "dbsnp_all").select(*cols).unionByName(table(spark, d, "dbsnp_common").select(*cols))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_references(_references(spark, d), _entries(spark, d)).select("tbl", "row_id")


def p1_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_counts(_references(spark, d), _entries(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return U.foreign_values(table(spark, d, "sumstats"), table(spark, d, "stat_files")).select("row_id", "field")


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sumstats").select("row_id", "file_id", "line_no", "effect_se", *U.FIELDS)
    return U.to_canonical(s, table(spark, d, "stat_files")).select("row_id", *U.FIELDS, *[f"{f}_unit" for f in U.FIELDS])


def p2_units(spark: SparkSession, d: str) -> DataFrame:
    """The unit of every value."""
    return U.value_conversions(table(spark, d, "sumstats"), table(spark, d, "stat_files")).select("row_id", "field", "unit")


def p2_conversions(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(U.compose(), "field string, unit string, a1 double, b1 double, bridge string, a2 double, b2 double")


def _schemas(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "column_info"), table(spark, d, "stat_files"), table(spark, d, "alias_names")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return D.drift(*_schemas(spark, d)).select("file_id", "field", "drift")


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    return D.drift(*_schemas(spark, d))


def p3_fields(spark: SparkSession, d: str) -> DataFrame:
    return D.fused_fields(*_schemas(spark, d))


def p3_new_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return D.new_alternatives(*_schemas(spark, d))


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the valid raw lines of all files in one table: in the branch of its own type and converted to the
    canonical type of its field."""
    return D.typed_values(E.cells(_lines(spark, d, layout=True)), *_schemas(spark, d)).drop("file_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "sumstats"), table(spark, d, "column_info")
    names = table(spark, d, "alias_names").select("standard_name").filter("standard_name is not null")
    return (
        P.split_variant_ids(s, "row_id", "variant_id", "sumstats.variant_id")
        .unionByName(P.split_names(c, "ci_id", "encoded_names", "column_info.encoded_names", names))
        .unionByName(P.split_delimiters(c, "ci_id", "delimiter", "column_info.delimiter"))
    )


def _lines(spark: SparkSession, d: str, layout: bool = False) -> DataFrame:
    return E.data_lines(table(spark, d, "raw_lines"), table(spark, d, "stat_files"), table(spark, d, "column_info"), table(spark, d, "alias_names"), layout=layout)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return E.failures(_lines(spark, d)).select("line_id", "reason")


def p5_repairs(spark: SparkSession, d: str) -> DataFrame:
    return E.failures(_lines(spark, d))


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    """All columns of the valid lines: the standard ones typed, the others as text in one map (here written out)."""
    t = E.loaded(_lines(spark, d, layout=True))
    further = F.array_join(F.array_sort(F.transform(F.map_entries("further"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "; ")
    return t.withColumn("further", further)


QUERIES = {f.__name__: f for f in (p1_found, p1_orphans_by_month, p2_found, p2_canonical, p2_units, p2_conversions, p3_found, p3_changes, p3_fields, p3_new_alternatives, p3_table, p4_found, p5_found, p5_repairs, p5_loaded)}

_ORPHANS = r"""
WITH RECURSIVE e AS (
  SELECT lower(regexp_replace(rsid, '^\s+|\s+$', '', 'g')) AS k, added_at, withdrawn_at, lower(regexp_replace(merged_into, '^\s+|\s+$', '', 'g')) AS m
  FROM (SELECT rsid, added_at, withdrawn_at, merged_into FROM dbsnp_all UNION ALL SELECT rsid, added_at, withdrawn_at, merged_into FROM dbsnp_common)),
al AS (SELECT DISTINCT k, m FROM e WHERE m IS NOT NULL),
res AS (SELECT k, m, 1 AS n FROM al UNION ALL SELECT res.k, al.m, n + 1 FROM res JOIN al ON al.k = res.m WHERE n < 200),
own AS (SELECT k, added_at, withdrawn_at FROM e WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.k = e.k)),
spells AS (SELECT * FROM own UNION ALL SELECT res.k, added_at, withdrawn_at FROM res JOIN own ON own.k = res.m),
refs AS (
  SELECT 'sumstats' AS tbl, row_id, lower(regexp_replace(rsid, '^\s+|\s+$', '', 'g')) AS k, loaded_at FROM sumstats
  UNION ALL SELECT 'eqtl_stats', eqtl_id, lower(regexp_replace(rsid, '^\s+|\s+$', '', 'g')), loaded_at FROM eqtl_stats),
good AS (SELECT * FROM refs WHERE regexp_full_match(k, 'rs[0-9]+')),
orphan AS (SELECT tbl, row_id, loaded_at FROM good g WHERE NOT EXISTS (
  SELECT 1 FROM spells s WHERE s.k = g.k AND s.added_at <= g.loaded_at AND (s.withdrawn_at IS NULL OR g.loaded_at < s.withdrawn_at)))
"""
_FIELDS = r"""
WITH al AS (SELECT regexp_replace(lower(input_name), '[^a-z0-9]', '', 'g') AS k, min(lower(trim(standard_name))) AS std FROM alias_names GROUP BY 1),
latest AS (SELECT file_id, col_index, arg_max(input_name, (recorded_at, ci_id)) AS input_name, arg_max(struct_pack(v := standard_name), (recorded_at, ci_id)).v AS standard_name,
  arg_max(struct_pack(v := class_name), (recorded_at, ci_id)).v AS class_name FROM column_info GROUP BY 1, 2),
c AS (SELECT file_id, col_index, regexp_replace(input_name, '^[\s"''`]+|[\s"''`]+$', '', 'g') AS name, lower(trim(standard_name)) AS std,
  regexp_replace(lower(input_name), '[^a-z0-9]', '', 'g') AS k,
  CASE lower(trim(class_name)) WHEN 'character' THEN 'string' WHEN 'varchar' THEN 'string' WHEN 'text' THEN 'string' WHEN 'factor' THEN 'string' WHEN 'char' THEN 'string'
    WHEN 'numeric' THEN 'double' WHEN 'float8' THEN 'double' WHEN 'float' THEN 'double' WHEN 'real' THEN 'double' WHEN 'double precision' THEN 'double'
    WHEN 'integer' THEN 'int' WHEN 'int4' THEN 'int' WHEN 'integer64' THEN 'bigint' WHEN 'int8' THEN 'bigint' WHEN 'long' THEN 'bigint'
    WHEN 'logical' THEN 'boolean' WHEN 'bool' THEN 'boolean' ELSE nullif(lower(trim(class_name)), '') END AS type FROM latest),
f AS (SELECT c.file_id, coalesce(nullif(c.std, ''), al.std, nullif(c.k, ''), nullif(c.name, '')) AS field, c.name, c.type, c.col_index FROM c LEFT JOIN al ON al.k = c.k),
cols AS (SELECT file_id, field, arg_min(name, col_index) AS name, arg_min(struct_pack(v := type), col_index).v AS type FROM f WHERE field IS NOT NULL GROUP BY 1, 2),
ord AS (SELECT file_id, lag(file_id) OVER (PARTITION BY series_id ORDER BY release_no, file_id) AS before FROM stat_files),
p AS (SELECT coalesce(n.file_id, o.file_id) AS file_id, coalesce(n.field, o.field) AS field, n.name AS nn, o.name AS oo, n.type AS nt, o.type AS ot,
  n.field IS NOT NULL AS has_new, o.field IS NOT NULL AS has_old
  FROM (SELECT cols.* FROM cols JOIN ord USING (file_id) WHERE before IS NOT NULL) n
  FULL JOIN (SELECT ord.file_id, cols.field, cols.name, cols.type FROM cols JOIN ord ON cols.file_id = ord.before) o ON n.file_id = o.file_id AND n.field = o.field)
"""
_CHANGES = """SELECT file_id, field, 'added' AS drift, NULL AS was, nn AS now FROM p WHERE NOT has_old
UNION ALL SELECT file_id, field, 'removed', oo, NULL FROM p WHERE NOT has_new
UNION ALL SELECT file_id, field, 'renamed', oo, nn FROM p WHERE has_old AND has_new AND nn IS DISTINCT FROM oo
UNION ALL SELECT file_id, field, 'retyped', ot, nt FROM p WHERE has_old AND has_new AND nt <> ot"""

#: Problem 4 without dictionary: quoted stretches, else stretches without separators; lists of delimiters by their joint.
_PACKED = r"""
WITH bare AS (
  SELECT field, row_key, regexp_replace(regexp_replace(cell, '^\s*(c\s*\(|\[|\{)\s*', ''), '\s*[\)\]\}]\s*$', '') AS cell, regexp_matches(cell, '^\s*(c\s*\(|\[|\{)') AS wrapped, cell AS whole
  FROM (SELECT 'sumstats.variant_id' AS field, row_id AS row_key, variant_id AS cell FROM sumstats UNION ALL
        SELECT 'column_info.encoded_names', ci_id, encoded_names FROM column_info UNION ALL SELECT 'column_info.delimiter', ci_id, delimiter FROM column_info) WHERE cell IS NOT NULL),
parts AS (SELECT field, row_key,
  CASE WHEN field = 'column_info.delimiter' AND NOT contains(whole, '"') AND NOT contains(whole, chr(39)) THEN string_split_regex(trim(whole), ' [,;] |\|')
       ELSE regexp_extract_all(CASE WHEN wrapped THEN cell ELSE whole END, '"[^"]*"|''[^'']*''|[^\s,;|/&"'']+') END AS items FROM bare),
clean AS (SELECT field, row_key, list_filter(list_transform(items, lambda x: trim(regexp_replace(x, '^["'']|["'']$', '', 'g'))), lambda x: x <> '') AS items FROM parts)
SELECT field, row_key, CAST(i AS INTEGER) AS pos_no, items[i] AS item FROM (SELECT field, row_key, items, unnest(range(1, len(items) + 1)) AS i FROM clean WHERE len(items) > 1)"""

#: The rules of problem 5 one by one, without repair.
_JUDGED = r"""
WITH seps(sep, esc, blank) AS (VALUES (chr(9), chr(9), ' '), (',', ',', ' ' || chr(9)), (';', ';', ' ' || chr(9)), ('|', '\|', ' ' || chr(9)), (' ', ' ', chr(9))),
pats AS (SELECT sep, '(?:[' || blank || ']*"(?:[^"]|"")*"[' || blank || ']*|[^"' || sep || ']*)' AS v, esc FROM seps),
body AS (SELECT * FROM raw_lines WHERE NOT starts_with(ltrim(raw_text), '##') AND regexp_replace(raw_text, '^\s+|\s+$', '', 'g') <> ''),
head AS (SELECT file_id, min(line_no) AS head_no, arg_min(line_id, (line_no, line_id)) AS head_id, arg_min(raw_text, (line_no, line_id)) AS head FROM body GROUP BY 1),
names AS (SELECT file_id, list(DISTINCT regexp_replace(input_name, '^[\s"''`]+|[\s"''`]+$', '', 'g')) AS names FROM column_info GROUP BY 1),
split AS (SELECT h.*, s.sep AS cand, list_transform(string_split(head, s.sep), lambda x: regexp_replace(x, '^[\s"''`]+|[\s"''`]+$', '', 'g')) AS cols, n.names FROM head h CROSS JOIN seps s LEFT JOIN names n USING (file_id)),
best AS (SELECT file_id, arg_max(cand, (len(list_intersect(cols, names)), len(cols))) AS sep FROM split GROUP BY 1),
al AS (SELECT regexp_replace(lower(input_name), '[^a-z0-9]', '', 'g') AS k, min(standard_name) AS std FROM alias_names GROUP BY 1),
latest AS (SELECT file_id, col_index, arg_max(input_name, (recorded_at, ci_id)) AS input_name, arg_max(struct_pack(v := standard_name), (recorded_at, ci_id)).v AS standard_name FROM column_info GROUP BY 1, 2),
typed AS (SELECT c.file_id, coalesce(nullif(lower(trim(standard_name)), ''), al.std, nullif(regexp_replace(lower(c.input_name), '[^a-z0-9]', '', 'g'), '')) AS field, arg_min(regexp_replace(input_name, '^[\s"''`]+|[\s"''`]+$', '', 'g'), col_index) AS name
  FROM latest c LEFT JOIN al ON al.k = regexp_replace(lower(c.input_name), '[^a-z0-9]', '', 'g') GROUP BY 1, 2),
h AS (SELECT h.file_id, h.head_no, h.head_id, s.cand AS sep, s.cols, list_position(s.cols, a.name) AS at_chr, list_position(s.cols, p.name) AS at_pos, list_position(s.cols, v.name) AS at_pval
  FROM head h JOIN best b USING (file_id) LEFT JOIN stat_files f USING (file_id) JOIN split s ON s.file_id = h.file_id AND s.cand = coalesce(nullif(f.sep, ''), b.sep)
  LEFT JOIN typed a ON a.file_id = h.file_id AND a.field = 'chr' LEFT JOIN typed p ON p.file_id = h.file_id AND p.field = 'pos' LEFT JOIN typed v ON v.file_id = h.file_id AND v.field = 'pval'),
l AS (SELECT b.line_id, b.file_id, b.line_no, h.cols, len(h.cols) AS n, at_chr, at_pos, at_pval, regexp_full_match(raw_text, p.v || '(?:' || p.esc || p.v || ')*') AS sound, regexp_extract_all(h.sep || raw_text, p.esc || '(' || p.v || ')', 1) AS raw
  FROM body b JOIN h USING (file_id) JOIN pats p ON p.sep = h.sep WHERE b.line_no > head_no OR (b.line_no = head_no AND b.line_id > head_id)),
t AS (SELECT *, list_transform(raw, lambda x: trim(x, ' ' || chr(9))) AS r FROM l),
f AS (SELECT *, list_transform(r, lambda x: CASE WHEN starts_with(x, '"') THEN trim(replace(substr(x, 2, length(x) - 2), '""', '"'), ' ' || chr(9)) ELSE x END) AS v FROM t),
j AS (SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN len(v) <> n THEN 'columns'
  WHEN at_chr > 0 AND NOT regexp_full_match(v[at_chr], '(?i)(chr)?([1-9]|1[0-9]|2[0-2]|X|Y|MT|M)') THEN 'chr'
  WHEN at_pos > 0 AND NOT (regexp_full_match(v[at_pos], '[0-9]+') AND coalesce(try_cast(v[at_pos] AS HUGEINT) BETWEEN 1 AND 2147483647, false)) THEN 'pos'
  WHEN at_pval > 0 AND v[at_pval] NOT IN ('', 'NA') AND NOT (regexp_full_match(v[at_pval], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(try_cast(v[at_pval] AS DOUBLE) BETWEEN 0 AND 1, false)) THEN 'pval' END AS reason FROM f)
"""
_LINES = _JUDGED + "SELECT line_id, reason FROM j WHERE reason IS NOT NULL"
_CELL = "max(value) FILTER (WHERE field = '{0}')"
_LOADED = (
    _JUDGED
    + """, c AS (SELECT line_id, file_id, line_no, unnest(range(1, n + 1)) AS place, unnest(cols) AS col, nullif(nullif(unnest(v), ''), 'NA') AS value FROM j WHERE reason IS NULL),
g AS (SELECT c.*, coalesce(t.field, nullif(regexp_replace(lower(c.col), '[^a-z0-9]', '', 'g'), ''), c.col) AS field FROM c LEFT JOIN typed t ON t.file_id = c.file_id AND t.name = c.col),
u AS (SELECT * FROM g WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line_id, field ORDER BY place) = 1),
x AS (SELECT *, CASE WHEN field = 'pos' THEN try_cast(value AS INTEGER) IS NOT NULL WHEN field IN ('effect', 'effect_se', 'odds_ratio', 'zscore', 'pval', 'log10p') THEN try_cast(value AS DOUBLE) IS NOT NULL
  ELSE field IN ('variant_id', 'rsid', 'chr', 'ref', 'alt', 'allele1', 'allele2') END AS typed_ok FROM u),
w AS (SELECT line_id, """
    + ", ".join(f"{_CELL.format(f)} AS {f}" for f in E.STANDARD)
    + """, coalesce(array_to_string(list_sort(list(field || '=' || value) FILTER (WHERE NOT typed_ok)), '; '), '') AS further FROM x GROUP BY 1)
SELECT j.line_id, j.file_id, j.line_no, """
    + ", ".join(
        "'chr' || CASE WHEN upper(regexp_replace(chr, '(?i)^chr', '')) = 'M' THEN 'MT' ELSE upper(regexp_replace(chr, '(?i)^chr', '')) END AS chr" if f == "chr" else f if t == "string" else f"try_cast({f} AS {'INTEGER' if t == 'int' else 'DOUBLE'}) AS {f}"
        for f, t in E.STANDARD.items()
    )
    + ", further FROM j LEFT JOIN w USING (line_id) WHERE reason IS NULL"
)

_CELLS = _JUDGED + """, c AS (SELECT line_id, file_id, unnest(range(1, n + 1)) AS place, unnest(cols) AS col, nullif(nullif(unnest(v), ''), 'NA') AS value FROM j WHERE reason IS NULL),
g AS (SELECT c.line_id, c.file_id, c.place, c.value, coalesce(t.field, nullif(regexp_replace(lower(c.col), '[^a-z0-9]', '', 'g'), ''), c.col) AS field FROM c LEFT JOIN typed t ON t.file_id = c.file_id AND t.name = c.col),
u AS (SELECT * FROM g WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line_id, field ORDER BY place) = 1)"""
_TYPES = _FIELDS + """, kinds AS (SELECT DISTINCT field, type FROM cols WHERE type IS NOT NULL), alt AS (SELECT field, list_sort(list(type)) AS t FROM kinds GROUP BY 1),
n AS (SELECT field, count(*) AS n_files, count(DISTINCT name) AS n_names FROM cols GROUP BY 1)"""

#: Conversions to the canonical units, written out: value -> a2 f(a1 x + b1) + b2.
_CONV = """conv(field, unit, a1, b1, bridge, a2, b2, no) AS (VALUES
 ('pval', 'prob', 1e0, 0e0, '', 1e0, 0e0, 0), ('pval', 'percent', 0.01e0, 0e0, '', 1e0, 0e0, 1), ('pval', 'ln', 1e0, 0e0, 'exp', 1e0, 0e0, 2), ('pval', 'neglog10', -ln(10), 0e0, 'exp', 1e0, 0e0, 3),
 ('log10p', 'neglog10', 1e0, 0e0, '', 1e0, 0e0, 0), ('log10p', 'log10', -1e0, 0e0, '', 1e0, 0e0, 1), ('log10p', 'negln', 1 / ln(10), 0e0, '', 1e0, 0e0, 2),
 ('effect', 'lnor', 1e0, 0e0, '', 1e0, 0e0, 0), ('effect', 'log10', ln(10), 0e0, '', 1e0, 0e0, 1), ('effect', 'log2', ln(2), 0e0, '', 1e0, 0e0, 2), ('effect', 'milli', 0.001e0, 0e0, '', 1e0, 0e0, 3),
 ('effect', 'smd', pi() / sqrt(3), 0e0, '', 1e0, 0e0, 4), ('effect', 'ratio', 1e0, 0e0, 'ln', 1e0, 0e0, 5),
 ('odds_ratio', 'ratio', 1e0, 0e0, '', 1e0, 0e0, 0), ('odds_ratio', 'ln', 1e0, 0e0, 'exp', 1e0, 0e0, 1), ('odds_ratio', 'percent', 0.01e0, 1e0, '', 1e0, 0e0, 2))"""
_POLY = "-1.26551223"
for _i, _c in enumerate((1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)):
    _POLY += f" + ({_c!r}) * pow(t, {_i + 1})"  # -log10 of the tail of the normal distribution, as in the operator
_VOTES = f"""
WITH {_CONV},
s AS (SELECT row_id, file_id, line_no, CASE WHEN effect_se > 0 AND NOT isnan(effect_se) THEN effect_se END AS se, effect, odds_ratio, pval, log10p FROM sumstats),
l AS (SELECT * FROM (UNPIVOT s ON effect, odds_ratio, pval, log10p INTO NAME field VALUE x) WHERE NOT isnan(x)),
y AS (SELECT l.*, c.unit, c.no, CASE WHEN bridge = 'exp' THEN CASE WHEN a1 * x + b1 < 700 THEN exp(a1 * x + b1) END WHEN bridge = 'ln' THEN CASE WHEN x > 0 THEN ln(x) END ELSE a1 * x + b1 END AS v FROM l JOIN conv c USING (field)),
z AS (SELECT *, CASE WHEN field = 'effect' THEN v WHEN field = 'odds_ratio' AND v > 0 THEN ln(v) END AS o FROM y),
n AS (SELECT *, abs(o / se) / sqrt(2) AS w, 1 / (1 + 0.5 * abs(o / se) / sqrt(2)) AS t FROM z),
g AS (SELECT row_id, file_id, line_no, field, unit, no, o, CASE WHEN field = 'pval' THEN CASE WHEN v > 0 AND v <= 1 THEN -log10(v) END WHEN field = 'log10p' THEN CASE WHEN v >= 0 THEN v END ELSE -(ln(t) - w * w + {_POLY}) / ln(10) END AS g FROM n),
pairs(k, fa, fb, rank) AS (VALUES (0, 'effect', 'pval', 10), (1, 'effect', 'log10p', 11), (2, 'odds_ratio', 'pval', 12), (3, 'odds_ratio', 'log10p', 13), (4, 'pval', 'log10p', 5), (5, 'effect', 'odds_ratio', 4)),
d AS (SELECT a.row_id, a.file_id, a.line_no, k, fa, fb, rank, a.unit AS ua, b.unit AS ub, a.no AS na, b.no AS nb,
  CASE WHEN k = 5 THEN abs(a.o - b.o) / (0.1 + least(abs(a.o), abs(b.o))) ELSE abs(a.g - b.g) / (1 + least(abs(a.g), abs(b.g))) END AS d
  FROM pairs JOIN g a ON a.field = fa JOIN g b ON b.row_id = a.row_id AND b.field = fb),
f AS (SELECT * FROM d WHERE d IS NOT NULL AND isfinite(d)),
best AS (SELECT row_id, k, arg_min(ua, (d, na, nb)) AS ba, arg_min(ub, (d, na, nb)) AS bb, min(d) AS low FROM f GROUP BY 1, 2 HAVING min(d) <= 0.002),
said AS (SELECT f.row_id, f.file_id, f.line_no, k, rank, fa, fb, ba, bb, min(CASE WHEN ua <> ba THEN d END) AS oa, min(CASE WHEN ub <> bb THEN d END) AS ob FROM f JOIN best USING (row_id, k) GROUP BY ALL),
each AS (SELECT row_id, file_id, line_no, rank, fa AS field, ba AS unit FROM said WHERE oa IS NULL OR oa > 0.02 UNION ALL SELECT row_id, file_id, line_no, rank, fb, bb FROM said WHERE ob IS NULL OR ob > 0.02),
votes AS (SELECT row_id, file_id, line_no, field, arg_max(unit, rank) AS unit FROM each GROUP BY 1, 2, 3, 4),
runs AS (SELECT file_id, field, unit, min(line_no) AS a, max(line_no) AS b FROM votes WHERE file_id IS NOT NULL AND line_no IS NOT NULL GROUP BY 1, 2, 3),
ord AS (SELECT *, lag(b) OVER w AS pb, lead(a) OVER w AS na FROM runs WINDOW w AS (PARTITION BY file_id, field ORDER BY a, b, unit)),
seg AS (SELECT *, bool_or(coalesce(pb >= a, false)) OVER (PARTITION BY file_id, field) AS mixed FROM ord),
spoken AS (SELECT file_id, field, arg_min(unit, (a, unit)) AS first_unit, any_value(mixed) AS mixed, count(*) > 1 AS several FROM seg GROUP BY 1, 2),
g2 AS (SELECT g.* FROM g WHERE file_id IN (SELECT file_id FROM spoken WHERE several) AND (EXISTS (SELECT 1 FROM runs r WHERE r.file_id = g.file_id AND r.field = g.field AND r.unit = g.unit)
  OR (no = 0 AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.file_id = g.file_id AND r.field = g.field)))),
d2 AS (SELECT a.row_id, a.file_id, a.line_no, k, fa, fb, rank, a.unit AS ua, b.unit AS ub, a.no AS na, b.no AS nb,
  CASE WHEN k = 5 THEN abs(a.o - b.o) / (0.1 + least(abs(a.o), abs(b.o))) ELSE abs(a.g - b.g) / (1 + least(abs(a.g), abs(b.g))) END AS d
  FROM pairs JOIN g2 a ON a.field = fa JOIN g2 b ON b.row_id = a.row_id AND b.field = fb),
f2 AS (SELECT * FROM d2 WHERE d IS NOT NULL AND isfinite(d)),
best2 AS (SELECT row_id, k, arg_min(ua, (d, na, nb)) AS ba, arg_min(ub, (d, na, nb)) AS bb, min(d) AS low FROM f2 GROUP BY 1, 2 HAVING min(d) <= 0.002),
said2 AS (SELECT f2.row_id, f2.file_id, f2.line_no, k, rank, fa, fb, ba, bb, min(CASE WHEN ua <> ba THEN d END) AS oa, min(CASE WHEN ub <> bb THEN d END) AS ob FROM f2 JOIN best2 USING (row_id, k) GROUP BY ALL),
each2 AS (SELECT row_id, file_id, line_no, rank, fa AS field, ba AS unit FROM said2 WHERE oa IS NULL OR oa > 0.02 UNION ALL SELECT row_id, file_id, line_no, rank, fb, bb FROM said2 WHERE ob IS NULL OR ob > 0.02),
votes2 AS (SELECT row_id, file_id, line_no, field, arg_max(unit, rank) AS unit FROM each2 GROUP BY 1, 2, 3, 4),
near AS (SELECT l.row_id, l.field, arg_min(v.unit, (abs(v.line_no - l.line_no), v.line_no, v.unit)) AS unit FROM l JOIN spoken p ON p.file_id = l.file_id AND p.field = l.field AND p.mixed
  JOIN votes v ON v.file_id = l.file_id AND v.field = l.field GROUP BY 1, 2),
unit_of AS (SELECT l.row_id, l.field, coalesce(
  CASE WHEN p.mixed THEN coalesce(v.unit, n.unit, p.first_unit) WHEN p.several THEN coalesce(v.unit, q.unit) ELSE q.unit END, CASE l.field WHEN 'pval' THEN 'prob' WHEN 'log10p' THEN 'neglog10' WHEN 'effect' THEN 'lnor' ELSE 'ratio' END) AS unit
  FROM l LEFT JOIN spoken p ON p.file_id = l.file_id AND p.field = l.field LEFT JOIN votes2 v ON v.row_id = l.row_id AND v.field = l.field LEFT JOIN near n ON n.row_id = l.row_id AND n.field = l.field
  LEFT JOIN seg q ON q.file_id = l.file_id AND q.field = l.field AND NOT q.mixed AND (q.pb IS NULL OR coalesce(l.line_no, 0) > (q.pb + q.a) // 2) AND (q.na IS NULL OR coalesce(l.line_no, 0) <= (q.b + q.na) // 2))
"""
_NUM = "regexp_full_match(value, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"
_INT = "regexp_full_match(value, '[+-]?[0-9]+')"
_CANONICAL = "CASE WHEN t IS NULL THEN 'string' WHEN len(t) = 1 THEN t[1] WHEN list_has_all(['bigint', 'int'], t) THEN 'bigint' WHEN list_has_all(['bigint', 'int', 'double'], t) THEN 'double' ELSE 'string' END"
_TABLE = f"""WITH own AS (SELECT * FROM ({_FIELDS} SELECT file_id, field, type FROM cols)),
kind AS (SELECT * FROM ({_TYPES} SELECT n.field, {_CANONICAL} AS canonical_type FROM n LEFT JOIN alt USING (field))),
v AS (SELECT u.line_id, u.field, u.value, coalesce(own.type, 'string') AS t, coalesce(kind.canonical_type, 'string') AS canonical_type
  FROM ({_CELLS} SELECT * FROM u) u LEFT JOIN own ON own.file_id = u.file_id AND own.field = u.field LEFT JOIN kind ON kind.field = u.field),
b AS (SELECT *, CASE WHEN t = 'int' AND {_INT} THEN try_cast(value AS INTEGER) END AS v_int, CASE WHEN t = 'bigint' AND {_INT} THEN try_cast(value AS BIGINT) END AS v_bigint,
  CASE WHEN t = 'double' AND {_NUM} THEN try_cast(value AS DOUBLE) END AS v_double, CASE WHEN t = 'boolean' AND upper(value) IN ('TRUE', 'T') THEN true WHEN t = 'boolean' AND upper(value) IN ('FALSE', 'F') THEN false END AS v_boolean FROM v),
g AS (SELECT *, CASE WHEN v_int IS NOT NULL THEN 'int' WHEN v_bigint IS NOT NULL THEN 'bigint' WHEN v_double IS NOT NULL THEN 'double' WHEN v_boolean IS NOT NULL THEN 'boolean' ELSE 'string' END AS tag,
  CASE WHEN canonical_type IN ('int', 'bigint', 'double') AND {_NUM} THEN try_cast(value AS DOUBLE) END AS as_number FROM b)
SELECT line_id, field, tag, v_int, v_bigint, v_double, v_boolean, CASE WHEN tag = 'string' THEN value END AS v_string, canonical_type, as_number, CASE WHEN as_number IS NULL THEN value END AS as_text FROM g"""

SQL = {
    "p2_conversions": f"WITH {_CONV} SELECT field, unit, a1, b1, bridge, a2, b2 FROM conv",
    "p2_units": _VOTES + "SELECT row_id, field, unit FROM unit_of",
    "p2_found": _VOTES + "SELECT row_id, field FROM unit_of WHERE unit NOT IN ('prob', 'neglog10', 'lnor', 'ratio') OR (unit = 'neglog10' AND field = 'pval') OR (unit = 'ratio' AND field = 'effect')",
    "p3_table": _TABLE,
    "p4_found": _PACKED,
    "p5_found": _LINES,
    "p5_loaded": _LOADED,
    "p3_fields": _TYPES
    + f" SELECT n.field, {_CANONICAL} AS canonical_type,"
    + """
 coalesce(array_to_string(t, '|'), '') AS alternatives, CASE WHEN len(t) > 1 THEN array_to_string(list_transform(t, lambda x: n.field || '__' || x), '|') ELSE '' END AS branches, n_files, n_names FROM n LEFT JOIN alt USING (field)""",
    "p3_new_alternatives": _FIELDS
    + """, f1 AS (SELECT series_id, field, type, min(release_no) AS release_no FROM cols JOIN stat_files USING (file_id) WHERE type IS NOT NULL GROUP BY 1, 2, 3)
SELECT series_id, field, type, release_no FROM f1 QUALIFY release_no > min(release_no) OVER (PARTITION BY series_id, field)""",
    "p1_found": _ORPHANS + "SELECT tbl, row_id FROM orphan",
    "p1_orphans_by_month": _ORPHANS
    + """, m AS (SELECT tbl, CAST(date_trunc('month', loaded_at AT TIME ZONE 'UTC') AS DATE) AS period, 1 AS n, 0 AS o FROM good
UNION ALL SELECT tbl, CAST(date_trunc('month', loaded_at AT TIME ZONE 'UTC') AS DATE), 0, 1 FROM orphan)
SELECT tbl, period, CAST(sum(n) AS BIGINT) AS n_refs, CAST(sum(o) AS BIGINT) AS n_orphans FROM m GROUP BY 1, 2""",
    "p3_found": _FIELDS + f"SELECT file_id, field, drift FROM ({_CHANGES})",
    "p3_changes": _FIELDS + _CHANGES,
}
