import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seqlab.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "8", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture
def heavy(spark):
    """Every key counts as heavy, so the skew paths run on small data."""
    spark.conf.set("seqlab.heavy.rows", "1")
    yield
    spark.conf.unset("seqlab.heavy.rows")


SF = "/root/testdata/sf0.001"


def make_sentences(spark, sents, split="train"):
    """[(word, tag), ...] lists as packed sentences."""
    rows = [(i, 0, split, [w for w, _ in s], [t for _, t in s]) for i, s in enumerate(sents)]
    return spark.createDataFrame(rows, "src_id long, seg int, split string, words array<string>, tags array<string>")
