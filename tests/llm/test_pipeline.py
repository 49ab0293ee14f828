"""The pipeline's stages in a row, each against a plain version of what it has to keep."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
from locusframe.llm import langid, packing, secrets
from locusframe.llm.common import written
from tests.llm.test_operators import WORD, components, shingles


def masked(text):
    """Every secret replaced by its kind; the union of spans that overlap by the kind of the first."""
    spans = sorted((m.start(), no, m.end(), r.kind) for no, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least)
    out, at = "", 0
    for start, _, end, kind in spans:
        if start >= at:
            out += text[at:start] + f"<{kind}>"
        at = max(at, end)
    return out + text[at:]


def passes(rows):
    """How often each document is begun; rows: (doc_id, source, size)."""
    size = Counter()
    for _, source, n in rows:
        size[source] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, target, left = {s: i % 3 + 1 for i, s in enumerate(order)}, {}, set(order)
    while left:
        level = (sum(size.values()) - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > 3 * size[s]}
        target |= {s: 3 * size[s] if over else weight[s] * level for s in over or left}
        left -= over or left
    out, by = Counter(), defaultdict(list)
    for i, source, n in rows:
        by[source].append((hashlib.md5(str(i).encode()).hexdigest(), i, n))
    for source, docs in by.items():
        goal, at = round(target[source]), 0
        for _, i, n in sorted(docs):
            whole = goal // size[source] if size[source] else 0
            out[i] += whole + (at < goal - whole * size[source]) if n else 1
            at += n
    return out


def test_every_stage_does_its_whole_job(spark, sf_dir):
    from tokenizers import Tokenizer

    docs, stages = spark.read.parquet(f"{sf_dir}/documents.parquet"), dict(corpus_pipeline.STAGES)
    columns, seen = docs.columns, {}
    for name, stage in stages.items():
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        seen[name] = (before.collect(), docs.collect())
        assert name == "packing" or docs.columns == columns

    before, after = seen["language_id"]
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.predict(start, *langid.learned(start)).collect()
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in found if r.lang_pred != "und" and r.score >= langid.KEEP)

    before, after = seen["near_duplicates"]
    sets = {r.doc_id: shingles(r.text) for r in before}
    assert len(sets) == len(before)
    of = components(sets)
    assert {r.doc_id for r in after} == {i for i in sets if of[i] == i} and len(after) == len({of[i] for i in sets})

    before, after = seen["secrets"]
    assert {r.doc_id: r.text for r in after} == {r.doc_id: r.text and masked(r.text) for r in before}

    before, after = seen["mixing"]
    want = passes([(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in before])
    assert Counter(r.doc_id for r in after) == +want

    before, after = seen["packing"]
    t = Tokenizer.from_file(packing.default_vocabulary())
    tokens, got, places = Counter(), Counter(), defaultdict(list)
    for r in before:
        tokens[r.doc_id] += len(t.encode(r.text or "", add_special_tokens=False).ids) + 1
    for r in after:
        got[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert got == tokens
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
