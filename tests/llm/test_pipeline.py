"""The corpus pipeline as a whole, and what the entry point does without this folder."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from livetick.llm import chosen_path, decontaminate, quality_qda, toxic_kn
from livetick.llm.common import table

ROOT = Path(__file__).resolve().parents[2]


def test_stages_narrow_and_keep_columns(spark, data_dir, tmp_path):
    docs = table(spark, data_dir, "documents")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    labels, bench = table(spark, data_dir, "labels"), table(spark, data_dir, "benchmark")
    plain = {
        "quality": lambda d: {r["doc_id"] for r in quality_qda.scored(d, labels).where("predicted = 1").collect()},
        "toxicity": lambda d: {r["doc_id"] for r in toxic_kn.scored(d, labels).where("predicted = 0").collect()},
        "near_duplicates": lambda d: {r["class_id"] for r in chosen_path.near_duplicates(d).collect()},
        "decontamination": lambda d: {r["doc_id"] for r in d.collect()} - {r["doc_id"] for r in decontaminate.matches(d, bench).collect()},
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, data_dir)
        assert kept.columns == columns
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r["doc_id"] for r in kept.collect()}
        assert ids == plain[name](docs) and ids <= before
        docs, before = kept, ids
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, data_dir).collect()} == before
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "tokens"]


def test_odd_and_empty_documents_pass_all_stages(spark, data_dir, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data_dir)
            docs.count()


def test_entry_point_without_this_folder(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('livetick.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and 'host_ticks' in e.queries() and 'host_ticks' in e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, timeout=120)
