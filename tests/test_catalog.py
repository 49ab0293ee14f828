"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from locusframe.plans import catalog

FAST = [
    "site_freq", "site_hardy", "site_pi", "mendel", "indv_het", "relatedness2", "snp_density", "tajima_d", "window_pi", "weir_fst", "hapcount", "geno_r2", "hap_r2", "geno_chisq", "diff_site_discordance",
    "diff_switch_error", "filter_bed", "filter_positions_overlap", "filter_thin", "filter_hwe", "mask_calls", "isec_window", "merge", "annotate", "subset", "contrast", "recode", "plink_ped", "query_template", "fill_fs",
]


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple("" if x is None or x != x else repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, tables, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).toArrow().to_pandas()
    want = tables.sql(catalog.ORACLES[name]).arrow().read_all().to_pandas() if hasattr(tables.sql("SELECT 1").arrow(), "read_all") else tables.sql(catalog.ORACLES[name]).arrow().to_pandas()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    numbers = lambda t: [float(x) if x.replace(".", "", 1).replace("-", "", 1).replace("e", "", 1).isdigit() else x for x in t]
    assert [numbers(r) for r in a] == [numbers(r) for r in b]


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.ORACLES) > 100
