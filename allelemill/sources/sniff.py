"""What a bounded sample of a text file tells about it: comments, separator, header, quoting, prefixes and types."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..plans.aliases import ENCODED, RSID, TEXT_COLUMNS, TRAIT_FORMAT, VCF_COLUMNS

SEPARATORS = ["\t", ",", ";", "|", " "]
MISSING = {"", "NA", "NaN", "nan", "null", "NULL", "."}


def comment_prefix(lines: list[str]) -> str | None:
    """The leading marks of the first line, if it is a comment. A single mark before what is a header is none."""
    if not lines:
        return None
    m = re.match(r'^[^A-Za-z0-9" ]+', lines[0])
    if not m or m[0] in SEPARATORS:
        return None
    mark = m[0]
    if len(mark) == 1 and len(lines) > 1 and not lines[1].startswith(mark):
        return None
    return mark


def separator(lines: list[str]) -> str:
    """The candidate that cuts the lines into most columns and does so most consistently."""
    best: tuple[float, int, str] | None = None
    for i, sep in enumerate(SEPARATORS):
        counts = [len(r) for r in csv.reader(lines[:100], delimiter=sep)]
        if not counts or counts[0] < 2:
            continue
        share = sum(c == counts[0] for c in counts) / len(counts)
        if best is None or (share >= 0.9, counts[0] * share) > (best[0] >= 0.9, best[1]):
            best = (share, int(counts[0] * share), sep)
    if best is None:
        raise ValueError("no separator found")
    return best[2]


def kind(values: list[str]) -> str:
    """The narrowest type that all values have; missing ones do not count."""
    seen = [v.strip() for v in values if v.strip() not in MISSING]
    if not seen:
        return "string"
    if all(v in ("TRUE", "FALSE", "T", "F", "true", "false") for v in seen):
        return "boolean"
    if all(re.fullmatch(r"[+-]?[0-9]{1,18}", v) for v in seen):
        return "int" if all(-(2**31) <= int(v) < 2**31 for v in seen) else "bigint"
    if all(re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?[Ii]nf", v) for v in seen):
        return "double"
    return "string"


@dataclass
class ColumnSpec:
    """One output column: where it comes from and how."""

    name: str
    input_name: str
    index: int
    kind: str = "string"
    part: int | None = None  # position in a split value
    split: str | None = None
    quoted: bool = False
    prefix: str | None = None
    unseen: bool = False  # no value in the sample
    derived: str | None = None  # ref_of_pair, alt_of_pair, ref_of_alleles, rsid_chr, rsid_pos


@dataclass
class Layout:
    comment: str | None
    trim: str | None
    sep: str
    header_line: str
    names: list[str]
    columns: list[ColumnSpec] = field(default_factory=list)
    needs_rsid: bool = False
    warnings: list[str] = field(default_factory=list)


def layout(lines: list[str], standard: dict[str, str], encoded: list[tuple] = ENCODED, trait_vcf: bool = True) -> Layout:
    """The layout of a file from its first lines."""
    mark = comment_prefix(lines)
    body = [x for x in lines if x.strip() and not (mark and x.startswith(mark))]
    if mark and not body:  # every line carries the mark
        mark, body = None, [x for x in lines if x.strip()]
    if not body:
        raise ValueError("no header found")
    m = re.match(r'^[^A-Za-z0-9" \t]+', body[0])
    trim = m[0] if m and m[0] not in SEPARATORS else None
    strip: Callable[[str], str] = lambda s: s[len(trim) :] if trim and s.startswith(trim) else s
    sep = separator([strip(x) for x in body])
    rows = list(csv.reader([strip(x) for x in body], delimiter=sep))
    names, sample = rows[0], rows[1:501]
    raw_first = strip(body[1]).split(sep) if len(body) > 1 else []
    out = Layout(mark, trim, sep, body[0], names)
    values = {i: [r[i] for r in sample if i < len(r)] for i in range(len(names))}
    plan: list[ColumnSpec] = []
    trait = trait_vcf and names[:9] == VCF_COLUMNS and len(names) == 10 and bool(re.fullmatch(r"[a-z0-9.-]+", names[9], re.I))
    keys = sample[0][8].split(":") if trait and sample and len(sample[0]) > 8 else []
    if trait and (not keys or any(k not in TRAIT_FORMAT for k in keys)):
        out.warnings.append(f"unknown FORMAT {':'.join(keys)}; {names[9]} is left as it is")
        keys = []
    for i, n in enumerate(names):
        std = standard.get(n)
        filled = [v for v in values[i] if v not in MISSING]
        if std == "rsid" and not (filled and all(re.match(RSID, v) for v in filled)):
            std = None
        spec = ColumnSpec(std or n, n, i, "string" if n in TEXT_COLUMNS else kind(values[i]), quoted=i < len(raw_first) and raw_first[i].startswith('"'), unseen=not filled and n not in TEXT_COLUMNS)
        if std == "chr":
            spec.kind = "string"
            spec.prefix = "chr" if filled and all(v.lower().startswith("chr") for v in filled) else None
        plan.append(spec)
    taken = [p.name for p in plan]
    done: list[ColumnSpec] = []
    pair = None
    for p in plan:
        done.append(p)
        if keys and p.index == 9:
            part = lambda k: [v.split(":")[k] for v in values[9] if len(v.split(":")) > k]
            done += [ColumnSpec(TRAIT_FORMAT[key], p.input_name, 9, kind(part(k)), k, ":") for k, key in enumerate(keys) if TRAIT_FORMAT[key] not in taken]
            continue
        filled = [v for v in values[p.index] if v not in MISSING]
        fits = [e for e in encoded if e[0] == p.input_name and filled and all(re.match(e[1], v) for v in filled)]
        if not fits:
            continue
        if len(fits) > 1:
            out.warnings.append(f"{p.input_name} fits several shapes; the first is taken")
        _, _, parts, split = fits[0]
        alleles = parts == ["ref", "alt"]
        if p.name == "rsid":
            p.name = p.input_name
        if alleles and "ref" not in taken and "alt" in taken:
            pair = p
            continue
        done += [ColumnSpec(n, p.input_name, p.index, "int" if n == "pos" else "string", k, split) for k, n in enumerate(parts) if n not in taken]
    if pair is not None:  # one column holds both alleles and another one the effect allele
        eff = next(p for p in done if p.name == "alt")
        eff.name = eff.input_name if eff.input_name != "alt" else "effect_allele"
        at = done.index(pair) + 1
        done[at:at] = [ColumnSpec(n, pair.input_name, pair.index, "string", k, "/", derived=d) for k, (n, d) in enumerate((("ref", "ref_of_pair"), ("alt", "alt_of_pair")))]
    have = {p.name for p in done}
    if {"allele1", "allele2", "alt"} <= have and "ref" not in have:
        at = next(i for i, p in enumerate(done) if p.name == "alt") + 1
        done.insert(at, ColumnSpec("ref", "allele1", -1, derived="ref_of_alleles"))
    have = {p.name for p in done}
    out.needs_rsid = "rsid" in have and not {"chr", "pos"} <= have
    seen: set[str] = set()
    for p in done:  # names stay unique
        base, k = p.name, 2
        while p.name in seen:
            p.name, k = f"{base}_{k}", k + 1
        seen.add(p.name)
    out.columns = done
    return out
