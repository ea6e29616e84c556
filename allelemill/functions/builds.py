"""Names of reference builds."""

from __future__ import annotations

#: Builds with chain data, with their other names. Fixed values.
BUILDS = ["b36", "b37", "b38"]
UCSC = {"b36": "hg18", "b37": "hg19", "b38": "hg38"}
SYNONYMS = {
    "hg18": "b36", "hg19": "b37", "hg38": "b38",
    "GRCh36": "b36", "GRCh37": "b37", "GRCh38": "b38",
    "grch36": "b36", "grch37": "b37", "grch38": "b38",
}


def normalise_build(build: str | None, allow_other: bool = True) -> str | None:
    """The canonical name. None stays None; other tags are kept, or refused with ValueError where coordinates must be
    converted."""
    if build is None or build == "none":
        return None
    name = SYNONYMS.get(build, build)
    if name not in BUILDS and not allow_other:
        raise ValueError(f"unknown build {build!r}; known are {', '.join(BUILDS)} and {', '.join(SYNONYMS)}")
    return name
