"""The pipeline against the brute-force versions of its stages."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from findery.llm.quality import judge  # noqa: E402
from test_decontaminate import brute as leaks  # noqa: E402
from test_decontaminate import words  # noqa: E402
from test_near_copies import brute as alike  # noqa: E402
from test_packing import check  # noqa: E402
from test_pii import slow as entities  # noqa: E402
from test_simhash import slow_components, slow_fingerprint  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, dtypes = docs.columns, docs.dtypes
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == columns and out.dtypes == dtypes, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if k == 4:
            check(rows, before)
            break
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows)
        if k == 0:
            kept = {r.doc_id for r in judge(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()}
            assert after == {i: t for i, t in before.items() if i in kept}
        elif k == 1:
            near = slow_components({i: slow_fingerprint(t) for i, t in before.items()})
            parts = {i: i for i in before}  # linked by fingerprint or by resemblance
            for _ in range(9):
                for a, b in [*alike(before)[0], *near.items()]:
                    parts[a] = parts[b] = min(parts[a], parts[b])
            assert after == {i: before[i] for i in set(parts.values())}
        elif k == 2:
            for i, t in before.items():
                n, hit, *_ = leaks(t, items)
                assert (i in after) == (hit == 0 or hit <= n / 2), i
                if i in after:
                    assert not leaks(after[i], items)[4]
                    assert len(words(after[i])) == n - hit
        else:
            assert set(after) == set(before)
            for i, t in after.items():
                assert not entities(t)
                assert (t == before[i]) or entities(before[i])
        before = after


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0


CLASHES = ["_doc", "_hash", "_host", "_spans", "row", "doc", "text_hash", "host", "body", "fp", "component", "kept", "n_words", "base", "more", "length", "piece", "_fp", "_salt"]


def test_stages_with_odd_rows(spark):
    own = " ".join(f"word{i}" for i in range(30))
    texts = {1: own, 2: own, 3: None, 4: "", 5: own.replace("word", "post") + " mail me at a@b.cd today", 6: "x " * 40_000, 7: own.replace("word", "term") + " +1 234 567 8901", None: own.replace("word", "null")}
    rows = [(i, t, None if i == 7 else "en", None if i in (5, 7) else "s", None, *[f"c{i}"] * len(CLASHES)) for i, t in texts.items()]
    rows += [rows[0], rows[-1]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == docs.columns, name
            assert stage(spark, docs.limit(0), SF).count() == 0, name
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "5", "7", "None", "None"]
    one = corpus_pipeline.near_duplicates(spark, kept, SF)
    assert sorted(str(r.doc_id) for r in one.collect()) == ["1", "5", "7", "None"]
    clean = corpus_pipeline.personal_data(spark, corpus_pipeline.decontamination(spark, one, SF), SF)
    got = {r.doc_id: r for r in clean.collect()}
    assert got[5].text == own.replace("word", "post") + " mail me at [EMAIL] today" and got[7].text.endswith("[PHONE]") and got[5]["_spans"] == "c5" and got[1].text == own
    assert corpus_pipeline.best_fit_packing(spark, clean, SF).count() == 4
