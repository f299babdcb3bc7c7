"""Exact deduplication against a plain grouping by text, in one and in several micro-batches."""

import hashlib
import random

import pytest

from panelspan.llm import exact_dedup

ODD = [(1, "a b"), (2, None), (3, ""), (1, "a b"), (None, "a b"), (None, "x"), (None, "x"), (7, "é" * 3000), (8, "é"), (9, "é"), (4, " "), (5, "A b")]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return ODD + [(i, rng.choice(["hot", f"t{rng.randrange(40)}", f"only {i}"]) * rng.choice([1, 1, 500])) for i in range(10, 200)]


def write(spark, path, rows, files=5, mode="overwrite"):
    frame = spark.createDataFrame([(i, t, "d", {"k": 1}, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, digest string, locator map<string,int>, _metadata int")
    frame.repartition(files).write.mode(mode).parquet(path)
    return path


def check(found, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(repr((i, keep[t or ""], len(groups[t or ""]))) for i, t in rows)
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size)) for r in found) == want
    assert sum(r.kept for r in found) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


@pytest.mark.parametrize("files", [None, 1])
@pytest.mark.parametrize("digest", [exact_dedup.SHA256, "substr(sha2(text, 256), 1, 1)", "'same'"])
def test_against_grouping(spark, tmp_path, rows, files, digest):
    if files and digest == "'same'":
        pytest.skip("one is enough")
    path = write(spark, str(tmp_path / "documents.parquet"), rows)
    found = exact_dedup.deduplicate(spark, path, digest, str(tmp_path / "state"), files).collect()
    check(found, rows)
    if digest == exact_dedup.SHA256:
        digests = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
        assert {r.digest for r in found} == digests


def test_single_file(spark, tmp_path):
    path = write(spark, str(tmp_path / "folder"), ODD, 1)
    (file,) = (tmp_path / "folder").glob("*.parquet")
    check(exact_dedup.deduplicate(spark, str(file)).collect(), ODD)
    check(exact_dedup.deduplicate(spark, path + "/").collect(), ODD)


def test_state_outlives_the_stream(spark, tmp_path, rows):
    path, state = str(tmp_path / "documents.parquet"), str(tmp_path / "state")
    write(spark, path, rows[:100], 2)
    first = {r.digest: r for r in exact_dedup.remember(spark, path, state).collect()}
    write(spark, path, rows[100:], 2, "append")
    then = {r.digest: r for r in exact_dedup.remember(spark, path, state).collect()}
    assert set(first) < set(then) and all(then[d].locator == first[d].locator for d in first)
    assert sum(r.n for r in then.values()) == len(rows)
    check(exact_dedup.deduplicate(spark, path, state=state).collect(), rows)


def test_empty_table(spark, tmp_path):
    path = write(spark, str(tmp_path / "documents.parquet"), [], 1)
    assert exact_dedup.deduplicate(spark, path).count() == 0
