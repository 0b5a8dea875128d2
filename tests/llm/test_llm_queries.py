"""Registered queries against DuckDB at a small size; the pipeline; the optional registration."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from helpers import docs_frame

import corpus_pipeline
from holdfast.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    duck.execute(f"CREATE OR REPLACE VIEW o AS {ORACLE[name]}")  # as the driver may load it
    found = duck.execute("SELECT * FROM o")
    columns = sorted(d[0] for d in found.description)
    want = found.df()[columns].values.tolist()
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert norm(map(tuple, got.select(*columns).collect())) == norm(map(tuple, want))


def test_queries_beyond_sql(spark):
    """op5 and op7 over the whole small table, against plain Python."""
    import hashlib
    import re

    from helpers import components, repeats
    from test_llm_near_duplicates import slow_fingerprint

    docs = sorted((x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect())
    ids, texts = [k for k, _ in docs], [t for _, t in docs]
    data, masks = repeats(texts, ids, 50, lambda t: t.encode())
    want = [(k, len(b), sum(m), len(re.findall(b"\1+", m)), hashlib.sha256(bytes(c for c, x in zip(b, m) if not x)).hexdigest())
            for k, b, m in zip(ids, data, masks)]
    got = QUERIES["op5_prefix_free_parsing"](spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == want
    prints = {k: slow_fingerprint(t or "") for k, t in docs}
    root = components(prints, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    got = QUERIES["op7_simhash"](spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == [(k, f"{prints[k]:016x}", root[k]) for k in ids]


def test_every_operator_is_registered():
    assert sorted(QUERIES, key=lambda k: int(k[2:].split("_")[0])) == sorted(QUERIES, key=lambda k: list(QUERIES).index(k))
    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 14))
    sys.path.insert(0, REPO)
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_pipeline_on_planted_cases(spark, tmp_path):
    """Each stage catches what it is for and leaves the other documents alone."""
    import random

    r = random.Random(4)
    vocabulary = [f"word{k}" for k in range(4000)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = [prose(r.randint(80, 200)) for _ in range(160)]
    texts += [prose(60) + " " + " ".join(r.choice(["vile", "grotty", "beastly"]) for _ in range(8)) + " " + prose(60) for _ in range(40)]
    labels = [(k, 1, int(k >= 160)) for k in range(200)]
    item, other = prose(30), prose(30)
    shared = prose(60)
    texts += [texts[0], texts[1].replace(texts[1].split()[5] + " ", "other ", 1) + " end", prose(70) + " " + item + " " + prose(70),
              prose(900) + " " + other, "first " + prose(50) + " " + shared, shared + " " + prose(70), None, ""]
    near = 201
    docs = docs_frame(spark, texts).selectExpr("*", "1 AS copies", "'x' AS id", "2 AS row")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, other)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = corpus_pipeline.written(stage(spark, before, str(tmp_path)), name)
        assert set(before.columns) <= set(kept.columns)
        seen.append({x.doc_id: x for x in kept.collect()})
    toxicity, simhash, substring, leaks, mix = seen
    assert sum(k in toxicity for k in range(160, 200)) <= 2 and set(range(160)) <= set(toxicity)
    assert 200 not in simhash and 0 in simhash and (near not in simhash or 1 in simhash)
    assert substring[205].text.split() == texts[205].split()[60:] and substring[204].text == texts[204] and substring[205].n_chars == len(substring[205].text)
    assert 202 not in leaks and 203 in leaks and leaks[203].text == texts[203]
    assert set(substring) - set(leaks) == {202}
    assert mix and all(x.copies in (1, 2, 3) for x in mix.values())
    assert not set(mix) - set(leaks)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = docs_frame(spark, ["a"]).limit(0)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


def test_pipeline_against_plain_python(spark, duck):
    """Every stage, applied to what the one before kept, against its plain version."""
    import pandas as pd
    from helpers import components, repeats, space_words
    from test_llm_decontamination_and_mixing import brute
    from test_llm_near_duplicates import slow_fingerprint

    from holdfast.llm import op3_pareto_mixing, op6_toxic_segments

    documents = corpus_pipeline.table(spark, SF, "documents")
    model = op6_toxic_segments.fit(documents, corpus_pipeline.table(spark, SF, "labels"), op6_toxic_segments.remainder(5) != 0)
    scores = {x.row.doc_id: x.score for x in op6_toxic_segments.score_toxicity(documents, model).collect()}
    want = {x.doc_id: x.text for x in documents.collect() if scores[x.doc_id] < 0.5}
    kept, steps = documents, []
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.written(stage(spark, kept, SF), name)
        steps.append({x.doc_id: x for x in kept.collect()})
    texts = [{k: x.text for k, x in step.items()} for step in steps]
    assert texts[0] == want

    prints = {k: slow_fingerprint(t or "") for k, t in want.items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    root = components(prints, links)
    want = {k: t for k, t in want.items() if root[k] == k}
    assert texts[1] == want

    ids = sorted(want)
    words, masks = repeats([want[k] for k in ids], ids, 13, space_words)
    left = {k: [w for w, m in zip(ws, mask) if not m] for k, ws, mask in zip(ids, words, masks)}
    want = {k: t for k, t in want.items() if left[k] or not space_words(t or "")}
    assert {k: space_words(t or "") for k, t in texts[2].items()} == {k: left[k] for k in want}
    want = texts[2]

    items = [(x.item_id, x.text) for x in corpus_pipeline.table(spark, SF, "benchmark").collect()]
    found = {k: brute(t, items) for k, t in want.items()}
    want = {k: t for k, t in want.items() if not found[k][1] or 20 * len(found[k][1]) < found[k][0]}
    assert texts[3] == want

    con = duckdb.connect()
    frame = pd.DataFrame([(k, x.text, x.source) for k, x in steps[3].items()], columns=["doc_id", "text", "source"])
    con.register("documents", frame)
    mix = con.execute(f"SELECT doc_id, taken // size FROM ({op3_pareto_mixing.ORACLE}) WHERE taken > 0").fetchall()
    assert {k: x.copies for k, x in steps[4].items()} == dict(mix)
    assert sorted(x.doc_id for x in corpus_pipeline.run(spark, SF).collect()) == sorted(steps[4])


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies"] and 0 < out.count() <= 200


def test_the_rest_imports_without_this_part(tmp_path):
    for name in ("__spark_entry__.py", "holdfast"):
        source = os.path.join(REPO, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_pipeline_leaves_only_what_its_result_needs(spark):
    from holdfast.session import checkpoint_root

    folder = os.path.join(checkpoint_root(spark).removeprefix("file:"), "holdfast-scratch")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SF)
    left = sorted(f.rsplit("-", 1)[0] for f in set(os.listdir(folder)) - before)
    assert out.count() >= 0 and not {"toxicity", "simhash_near_dedup", "substring_dedup", "fingerprints", "found"} & set(left)
