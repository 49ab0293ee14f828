"""The data model: a cohort is one row a site, one row a (site, sample) call, and the samples in header order."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

SITES = (
    "site_id long, chrom string, pos int, id string, ref string, alt array<string>, qual double, filter array<string>, "
    "info map<string,string>, info_raw string, format array<string>, line_no long"
)
CALLS = "site_id long, sample_id string, a1 int, a2 int, ploidy tinyint, phased boolean, gq double, dp int, ft array<string>, fmt map<string,string>, included boolean"
SAMPLES = "sample_id string, sample_idx int"


@dataclass(frozen=True)
class Field:
    """One INFO, FORMAT, FILTER or contig line of a header."""

    kind: str
    id: str
    number: str = "1"
    type: str = "String"
    description: str = ""


@dataclass(frozen=True)
class Cohort:
    """Lazy tables of one variant file.  A masked call keeps its row with included = false (it still counts towards the
    chromosomes of its site), a missing allele is null, a haploid call has ploidy 1 and no a2."""

    sites: DataFrame
    calls: DataFrame
    samples: DataFrame
    header: list[str] = field(default_factory=list)
    fields: list[Field] = field(default_factory=list)

    def with_(self, **changes) -> Cohort:
        return replace(self, **changes)
