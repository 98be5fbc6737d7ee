"""The corpus pipeline, each stage held against a plain version on that stage's own input."""

from __future__ import annotations

import sys
from pathlib import Path

import public_tokenizers

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

from wayfarer.llm.common import staged, table  # noqa: E402
from wayfarer.llm.quality import quality  # noqa: E402
from wayfarer.llm.toxicity import toxicity  # noqa: E402


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        last, docs = docs, staged(stage(spark, docs, sf_dir), f"test-{name}")
        if name == "packing":
            ids = dict(zip([i for i, _ in before], brute.token_ids([t or "" for _, t in before], public_tokenizers.path("byte_bpe_50k.json"), 2), strict=True))
            brute.packed_right([tuple(r) for r in docs.collect()], ids)
            continue
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name in ("toxicity", "quality"):
            scored = (toxicity if name == "toxicity" else quality)(table(spark, sf_dir, "documents") if name == "toxicity" else last, table(spark, sf_dir, "labels"))
            assert set(after) == {r["doc_id"] for r in scored.where(f"predicted = {int(name == 'quality')}").collect()}
            assert set(after) < {i for i, _ in before}
            assert len(after) > len(before) / 2
        elif name == "near_dedup":
            assert set(after) == {i for i, (_, c) in brute.near_text(before).items() if i == c}
        else:
            for i, (n, gone, _) in brute.substring(before).items():
                assert len(brute.WORD.findall(after[i] or "")) == n - gone
        if name != "substring_dedup":
            assert all(after[i] == t for i, t in before if i in after)


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, blanks, repeated ids and rows, and columns named like those inside."""
    t = " ".join(f"w{i} and so on." for i in range(40))
    rows = [(5, t), (5, t), (7, t + " more"), (None, t), (None, None), (9, None), (9, ""), (9, " \n"), (5, "Another text."), (2**40, "x " * 3000)]
    docs = spark.createDataFrame([(i, x, "en", "s", None if x is None else len(x), "text_id", 1.5) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long, _text string, score double")
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, sf_dir), f"odd-{name}")
        if name == "packing":
            assert out.where("piece = 0").count() == docs.count()
            continue
        assert out.schema == docs.schema
        got, known = out.collect(), docs.collect()
        if name in ("toxicity", "quality"):
            assert all(r in known for r in got)
        elif name == "near_dedup":
            assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted((i or 0, x or "") for i, x in rows if i != 7)
        else:
            assert len(got) == len(rows) and sum(r["text"] is None for r in got) == 2
            assert {r["doc_id"]: len((r["text"] or "").split()) for r in got if r["doc_id"] == 7} == {7: 1}


def test_stages_on_no_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0 and (name == "packing" or out.schema == docs.schema)


def test_run_is_all_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
