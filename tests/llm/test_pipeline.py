"""The pipeline against plain versions of its stages, the entry without this subpackage, and the remaining queries."""

import collections
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from brute import SCHEMA, contaminated, near_duplicates, odd_documents, repeats
from tokenizers import Tokenizer

import corpus_pipeline as C

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(odd_documents(7), SCHEMA).write.parquet(f"{path}/documents.parquet")
    text = next(r[1] for r in odd_documents(7) if r[0] == 303)[100:400]
    items = [(1, "never seen words " * 4), (2, text), (3, None), (None, "a b")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


def test_stages(spark, folder, tmp_path):
    sf_dir, items = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            break
        assert docs.columns == names
        got = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "language":
            kept = [(i, t) for i, t in kept if any(c.isalpha() for c in t or "")]
        elif name == "near_duplicates":
            found = near_duplicates(kept)
            kept = [(i, t) for i, t in kept if found[i, t][2]]
            # Of rows that share an id one stays, the first by its columns.
            first = {}
            for i, t in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
                first.setdefault(i if i is not None else object(), (i, t))
            kept = list(first.values())
        elif name == "repeats":
            kept = [(i, left.decode(errors="ignore")) for (i, t), (_, _, _, left) in zip(kept, repeats([t for _, t in kept]))]
        else:
            kept = [(i, t) for i, t in kept if not contaminated(t, items)[1]]
        assert collections.Counter(got) == collections.Counter(kept), name
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    tokenizer = Tokenizer.from_file(C.TOKENIZER)
    rows = docs.collect()
    assert sum(r.length for r in rows) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in kept)
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096


def test_without_languages_to_learn_only_texts_without_letters_leave(spark):
    docs = spark.createDataFrame([(*r[:2], None, *r[3:]) for r in odd_documents(7)], SCHEMA)
    got = collections.Counter((r.doc_id, r.text) for r in C.keep_known_languages(spark, docs, "").collect())
    want = collections.Counter((r.doc_id, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    assert got == want and want


def test_empty_documents_run_through(spark, folder, tmp_path):
    sf_dir, _ = folder
    path = f"{tmp_path}/none"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    assert C.run(spark, path).count() == 0


def test_the_rest_stands_alone():
    """With the subpackage and the pipeline hidden, the entry still lists the other queries; other faults are not swallowed."""
    hide = (
        "import sys\n"
        "class Hide:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'factloom.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Hide())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert 'q05_impact' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q\n"
        "assert set(e.oracle_sql()) <= set(q)\n"
    )
    assert subprocess.run([sys.executable, "-c", hide], cwd=ROOT, capture_output=True).returncode == 0
    listed = "import __spark_entry__ as e; q = e.queries(); assert sum(n.startswith('op') for n in q) == 13 and 'pipeline' in q"
    assert subprocess.run([sys.executable, "-c", listed], cwd=ROOT, capture_output=True).returncode == 0
