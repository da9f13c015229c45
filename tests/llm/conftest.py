import os

import pytest
from odd_tables import CLASHES, ODD_TEXTS, PASSAGE

from umbral.llm.text import small_batches


@pytest.fixture(scope="session")
def llm(spark):
    small_batches(spark)
    return spark


@pytest.fixture(scope="session")
def odd(llm):
    """Missing, empty, long, tied and repeated texts, with extra columns."""
    rows = [(i, t, "en" if k % 3 else None, "src", len(t or "")) for k, (i, t) in enumerate(ODD_TEXTS)]
    df = llm.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return with_clashes(df).cache()


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit(v) for n, v in CLASHES.items()})


@pytest.fixture(scope="session")
def odd_labels(llm):
    rows = [(i, q, t) for i, q, t in [(4, 1, 0), (5, 1, 0), (6, 0, 1), (7, 0, 0), (8, 1, None), (None, 1, 1), (10, None, 0), (4, 1, 0), (99, 1, 1)]]
    return llm.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_benchmark(llm):
    rows = [(1, PASSAGE), (2, PASSAGE.title()), (3, None), (4, ""), (5, "two words"), (None, "Same LINE"), (6, "nothing of this occurs anywhere at all in any text"), (7, "one"), (7, "line")]
    return llm.createDataFrame(rows, "item_id bigint, text string")


@pytest.fixture(scope="session")
def odd_folder(odd, odd_labels, odd_benchmark, tmp_path_factory):
    """The odd tables as files."""
    folder = str(tmp_path_factory.mktemp("odd"))
    for name, df in (("documents", odd.drop("value")), ("labels", odd_labels), ("benchmark", odd_benchmark)):
        df.write.parquet(os.path.join(folder, f"{name}.parquet"))
    return folder
