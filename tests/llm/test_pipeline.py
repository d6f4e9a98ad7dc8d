import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from broadloom.llm import language_id, token_counts
from tests.llm.conftest import CLASHES, ODD
from tests.llm.test_dedup import brute_components
from tests.llm.test_texts import brute_hits
from tests.llm.test_tokens import check_packing

ROOT = Path(entry.__file__).resolve().parent


def test_pipeline_against_brute_force(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    found = {r["doc_id"]: r for r in language_id.identify(documents).collect()}
    rows = {i: t for i, t in rows.items() if found[i]["lang_pred"] != "und" and found[i]["score"] >= 0.5}
    last = {t: i for i, t in sorted(rows.items())}
    rows = {i: t for i, t in rows.items() if last[t] == i}
    parts = brute_components(list(rows.items()))
    rows = {i: t for (i, t), (n, least) in zip(rows.items(), parts, strict=True) if not n or least == i}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {r[0] for r in brute_hits(rows.items(), items) if r[-1]}
    rows = {i: t for i, t in rows.items() if i not in hit}
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(rows) > 100 and hit
    check_packing(packed, list(rows.items()), Tokenizer.from_file(token_counts.default_tokenizer()))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd, empty, name, stage):
    for docs in (odd, empty):
        out = stage(spark, docs, sf_dir)
        n = out.count()
        assert n <= 200 and (n > 0) == (docs is odd)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
    assert set(CLASHES) <= set(odd.columns)


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and "op2_exact_dedup" in entry.oracle_sql()


def test_entry_without_the_optional_part(tmp_path):
    def left_out(folder, names):
        return [n for n in names if n in ("llm", "corpus_pipeline.py", ".git", "__pycache__", "tests")]

    shutil.copytree(ROOT, tmp_path / "repo", ignore=left_out)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"],
        cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120,
    )
    assert said.returncode == 0, said.stderr
    n, pipeline = said.stdout.split()
    assert int(n) == len(entry.queries()) - 14 and pipeline == "False"
