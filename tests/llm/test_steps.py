"""In how many steps and files the linking of documents is written."""

import glob
import random

import pytest

from lodestone.llm import common, components as cc, ngram_join as nj
from lodestone.session import setting, written


@pytest.fixture
def folders(monkeypatch):
    """The folders of the steps written."""
    made = []

    def kept(df, *options):
        table, path = written(df, *options)
        made.append(path)
        return table, path

    monkeypatch.setattr(common, "written", kept)
    return made


def _files(path):
    return len(glob.glob(f"{path.removeprefix('file:')}/part-*"))


def test_stars_need_no_round(spark, folders):
    links = spark.createDataFrame([(9, 1), (1, 5), (2, 7), (7, 2), (3, 3)], "a long, b long")
    assert sorted(map(tuple, cc.components(links).collect())) == [(1, 1), (2, 2), (5, 1), (7, 2), (9, 1)]
    assert len(folders) == 1


def test_chains_are_followed_to_their_end(spark, folders):
    chain = list(range(0, 200, 2))
    random.Random(1).shuffle(chain)
    links = spark.createDataFrame([*zip(chain, chain[1:]), (301, 303), (303, 301), (305, 303)], "a long, b long")
    found = dict(map(tuple, cc.components(links).collect()))
    assert found == {**{n: 0 for n in chain}, 301: 301, 303: 301, 305: 301}
    assert len(folders) > 2
    assert cc.components(links.limit(0)).collect() == []


def test_few_documents_make_few_files(spark, folders):
    """However many shuffle partitions the session has."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:k], f"x{g}", *base[k + 1 :], f"g{g % 20}"]) for g in range(80) for k in (5, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wide = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    with setting(spark, wide):
        many = sorted(map(tuple, nj.ngram_components(docs).collect()))
    # the first step comes in the parts of the documents
    assert max(map(_files, folders[1:])) <= spark.sparkContext.defaultParallelism
    assert many == sorted(map(tuple, nj.ngram_components(docs).collect()))
