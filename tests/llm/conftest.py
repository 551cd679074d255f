import pytest

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return DIR


@pytest.fixture(scope="session")
def model_file():
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


#: Awkward texts: null, empty, blank, one word, ties, other scripts, a very long one.
TEXTS = [None, "", " \n\t ", "word", "The cat sat on the mat. The cat sat on the mat.", "THE cat sat on the mat. The cat sat on the mat.", "日本語 テキスト 🙂", "a" * 3000, "x y " * 20000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, a repeated row, a null id, and columns whose names operators use inside."""
    rows = [(i, t, "en" if i % 2 else None, "s", 0, "k", 1) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "The cat sat on the mat. The cat sat on the mat.", "en", "s", 0, "k", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, score int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
