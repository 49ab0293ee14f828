"""Variants as edits of a reference sequence: one form for all spellings of an edit, comparisons by sequence, conversions
between versions of the file format.  A reference is chunks (chrom, start, seq), as in ``operators.sequence``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.alleles import event_type
from locusframe.functions.fields import once
from locusframe.operators.sequence import bases_at
from locusframe.operators.stretches import runs
from locusframe.schema import Cohort
from locusframe.tables import written

#: Bases before an edit that are looked at in the first round.
FLANK = 100


def _common_end(a: Column, b: Column) -> Column:
    """How many last letters two texts share."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(a, F.length(a) - i + 1, F.lit(1)) != F.substr(b, F.length(b) - i + 1, F.lit(1)))
    return F.coalesce(F.get(differ, F.lit(0)) - 1, n)


def _common_start(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.coalesce(F.get(differ, F.lit(0)) - 1, n)


def _trimmed(pos: Column, gone: Column, new: Column) -> Column:
    """(pos, gone, new) without the letters that both ends share, the last ones first."""

    def ended(v: Column) -> Column:
        n = _common_end(v["gone"], v["new"])
        return F.struct(v["pos"].alias("pos"), F.substr(v["gone"], F.lit(1), F.length(v["gone"]) - n).alias("gone"), F.substr(v["new"], F.lit(1), F.length(v["new"]) - n).alias("new"))

    def started(v: Column) -> Column:
        n = _common_start(v["gone"], v["new"])
        return F.struct((v["pos"] + n).alias("pos"), F.substr(v["gone"], n + 1).alias("gone"), F.substr(v["new"], n + 1).alias("new"))

    return once(once(F.struct(pos.alias("pos"), gone.alias("gone"), new.alias("new")), ended), started)


def canonical(edits: DataFrame, reference: DataFrame, flank: int = FLANK) -> DataFrame:
    """edits: (key, chrom, pos, length, new, ...): ``length`` bases from pos on become ``new``.  Adds at, gone and put: the same for
    all edits that make the same sequence.  What an edit's two texts share is cut off, and an insertion or deletion moves
    as far to the left as the sequence stays the same: up to ``flank`` bases, then four times as many a round for those
    that can go on."""
    rows = edits.withColumnRenamed("key", "site_id")
    rows = bases_at(rows, reference, 0, F.greatest(F.col("length") - 1, F.lit(0)))
    own = F.upper(F.substr("bases", F.lit(1), F.col("length")))
    rows = rows.withColumn("_e", _trimmed(F.col("pos").cast("int"), own, F.upper("new"))).drop("bases")
    rows = rows.withColumns({"at": F.col("_e.pos"), "gone": F.col("_e.gone"), "put": F.col("_e.new")}).drop("_e")
    pure = (F.length("gone") == 0) != (F.length("put") == 0)
    rows = written(rows, "edits")
    done, open_ = rows.filter(~pure), rows.filter(pure)
    while not open_.isEmpty():
        ahead = bases_at(open_.select("site_id", "chrom", F.col("at").alias("pos")), reference, flank, 0).select("site_id", F.upper(F.substr("bases", F.lit(1), F.lit(flank))).alias("_f"))
        text = F.concat("gone", "put")  # one of them is empty
        k = F.length(text)
        unlike = F.filter(F.sequence(F.lit(1), F.lit(flank)), lambda i: F.substr("_f", F.lit(flank + 1) - i, F.lit(1)) != F.substr(text, k - (i - 1) % k, F.lit(1)))  # noqa: B023
        moved = open_.join(ahead, "site_id").withColumn("_m", F.least(F.coalesce(F.get(unlike, F.lit(0)) - 1, F.lit(flank)), F.col("at") - 1))
        turned = F.concat(F.substr(text, k - F.col("_m") % k + 1), F.substr(text, F.lit(1), k - F.col("_m") % k))
        moved = moved.withColumns({"gone": F.when(F.length("gone") > 0, turned).otherwise(""), "put": F.when(F.length("put") > 0, turned).otherwise(""), "at": F.col("at") - F.col("_m"), "_more": (F.col("_m") == flank) & (F.col("at") - F.col("_m") > 1)})
        moved = written(moved.drop("_f", "_m"), "edits")
        done = done.unionByName(moved.filter(~F.col("_more")).drop("_more"))
        open_, flank = moved.filter("_more").drop("_more"), flank * 4
    return done.withColumnRenamed("site_id", "key")


def compare_sequences(cohorts: list[Cohort], reference: DataFrame, gap: int = 0) -> DataFrame:
    """Records of all inputs in clusters (at most ``gap`` bases from one to the next): chrom, first and last position, files (the
    inputs with an insertion, deletion or complex change, from 0) and whether every two of them have a variant that
    makes the same sequence.  Every ALT is a variant by itself; clusters with one such input are left out."""
    sites = reduce(DataFrame.unionByName, [c.sites.select(F.lit(i).alias("src"), "site_id", "chrom", "pos", "ref", "alt") for i, c in enumerate(cohorts)])
    near = runs(sites, ["chrom"], F.col("pos") + gap + 1, ["src", "site_id"])
    each = near.select("src", "site_id", "chrom", "pos", "run", F.length("ref").alias("length"), "ref", F.posexplode("alt").alias("_i", "new")).filter(F.col("new").rlike("^[ACGTNacgtn]+$"))
    kind = event_type(F.col("ref"), F.col("new"))
    each = each.withColumns({"key": F.concat_ws(":", "src", "site_id", "_i"), "complex": (F.length("new") != F.col("length")) | ((F.col("length") > 1) & (kind == "o"))})
    told = each.groupBy("chrom", "run", "src").agg(F.bool_or("complex").alias("complex")).filter("complex")
    many = told.groupBy("chrom", "run").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("src")), ",").alias("files")).filter("n > 1")
    span = near.groupBy("chrom", "run").agg(F.max("pos").alias("last"))
    used = each.join(told.select("chrom", "run", "src"), ["chrom", "run", "src"]).join(many.select("chrom", "run"), ["chrom", "run"])
    forms = canonical(used.select("key", "chrom", "pos", "length", "new", "run", "src"), reference).select("chrom", "run", "src", "at", "gone", "put").distinct()
    other = forms.withColumnRenamed("src", "other")
    pairs = forms.join(other, ["chrom", "run", "at", "gone", "put"]).filter("src < other").select("chrom", "run", "src", "other").distinct().groupBy("chrom", "run").agg(F.count(F.lit(1)).alias("alike"))
    out = many.join(span, ["chrom", "run"]).join(pairs, ["chrom", "run"], "left")
    return out.select("chrom", F.col("run").alias("first"), "last", "files", (F.coalesce("alike", F.lit(0)) == F.col("n") * (F.col("n") - 1) / 2).alias("match"))


def sequence_matches(cohorts: list[Cohort], reference: DataFrame, gap: int = 0) -> DataFrame:
    """Clusters that match and that don't, by the inputs that have them."""
    return compare_sequences(cohorts, reference, gap).groupBy("files").agg(F.count_if("match").alias("n_match"), F.count_if(~F.col("match")).alias("n_mismatch"))


def to_anchored(sites: DataFrame, reference: DataFrame) -> DataFrame:
    """Sites of the old form, whose ALT may be I and inserted bases or D and a number of deleted ones, both behind the
    first base of REF, in the form that has the bases in REF and ALT.  REF becomes the longest that an ALT needs, and the
    others are extended by the same bases.  A site whose first base is not the reference's keeps its old form."""
    deleted = lambda a: F.when(a.rlike(r"^D\d+$"), F.substr(a, F.lit(2)).cast("int")).otherwise(0)
    indel = F.exists("alt", lambda a: a.rlike(r"^(I[ACGTNacgtn]+|D\d+)$"))
    rows = sites.withColumns({"_indel": indel, "_most": F.greatest(F.length("ref"), F.coalesce(F.array_max(F.transform("alt", deleted)), F.lit(0)) + 1)})
    rows = bases_at(rows, reference, 0, F.col("_most") - 1)
    fits = F.col("_indel") & (F.upper(F.substr("bases", F.lit(1), F.lit(1))) == F.upper(F.substr("ref", F.lit(1), F.lit(1))))
    long = F.concat("ref", F.upper(F.substr("bases", F.length("ref") + 1)))
    rest = lambda n: F.substr(long, n + 1)
    new = lambda a: (
        F.when(a.rlike("^I"), F.concat(F.substr("ref", F.lit(1), F.lit(1)), F.substr(a, F.lit(2)), rest(F.lit(1)))).when(a.rlike("^D"), F.concat(F.substr("ref", F.lit(1), F.lit(1)), rest(deleted(a) + 1)))
        .otherwise(F.concat(a, rest(F.length("ref"))))
    )
    # in two steps: beside an alias "ref", a lambda's ref would be that alias
    rows = rows.withColumns({"_alt": F.when(fits, F.transform("alt", new)).otherwise(F.col("alt")), "_ref": F.when(fits, long).otherwise(F.col("ref"))})
    return rows.withColumns({"alt": F.col("_alt"), "ref": F.col("_ref")}).drop("bases", "_indel", "_most", "_alt", "_ref")


def to_marked(sites: DataFrame) -> DataFrame:
    """Sites in the old form, a row for every one into which a site falls apart: ALTs of REF's length stay together, each insertion
    or deletion that is anchored by its first base becomes I with its bases or D with its length, at the base before it.
    What is neither (a longer change) stays as it is."""

    def event(a: Column) -> Column:
        def cut(v: Column) -> Column:
            anchor = F.substr(F.col("ref"), v["pos"] - 1, F.lit(1))
            inserted, lost = F.length(v["gone"]) == 0, F.length(v["new"]) == 0
            marked = F.when(inserted & (F.length(v["new"]) > 0), F.concat(F.lit("I"), v["new"])).when(lost & (F.length(v["gone"]) > 0), F.concat(F.lit("D"), F.length(v["gone"]).cast("string")))
            ok = marked.isNotNull() & (v["pos"] > 1)
            return F.struct(F.when(ok, v["pos"] - 2).otherwise(0).alias("shift"), F.when(ok, anchor).otherwise(F.col("ref")).alias("ref"), F.when(ok, marked).otherwise(a).alias("alt"))

        # the common start first, so that the anchor is where the file has it
        def shared(v: Column) -> Column:
            n = _common_start(v["gone"], v["new"])
            return F.struct((n + 1).alias("pos"), F.substr(v["gone"], n + 1).alias("gone"), F.substr(v["new"], n + 1).alias("new"))

        def ended(v: Column) -> Column:
            n = _common_end(v["gone"], v["new"])
            return F.struct(v["pos"].alias("pos"), F.substr(v["gone"], F.lit(1), F.length(v["gone"]) - n).alias("gone"), F.substr(v["new"], F.lit(1), F.length(v["new"]) - n).alias("new"))

        whole = F.struct(F.lit(1).alias("pos"), F.col("ref").alias("gone"), a.alias("new"))
        plain = a.rlike("^[ACGTNacgtn]+$") & (F.length(a) != F.length("ref"))
        return F.when(plain, once(once(once(whole, shared), ended), cut)).otherwise(F.struct(F.lit(0).alias("shift"), F.col("ref").alias("ref"), a.alias("alt")))

    events = F.transform("alt", event)
    rows = sites.withColumn("_e", F.when(F.size("alt") > 0, events).otherwise(F.array(F.struct(F.lit(0).alias("shift"), F.col("ref").alias("ref"), F.lit(None).cast("string").alias("alt")))))
    groups = F.array_distinct(F.transform("_e", lambda e: F.struct(e["shift"].alias("shift"), e["ref"].alias("ref"))))
    rows = rows.withColumn("_g", F.explode(groups))
    alts = F.transform(F.filter("_e", lambda e: (e["shift"] == F.col("_g.shift")) & (e["ref"] == F.col("_g.ref"))), lambda e: e["alt"])
    return rows.withColumns({"pos": F.col("pos") + F.col("_g.shift"), "ref": F.col("_g.ref"), "alt": F.array_compact(alts)}).drop("_e", "_g")
