import pytest

LONG = " ".join(f"w{i % 977}x{i}" for i in range(40000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 3


def odd_rows():
    """Nulls in every column, empty, blank, very long and repeated texts, equal and null ids, texts of one word."""
    texts = [None, "", " \n\t ", "x", "one two three", LONG, BASE, BASE, BASE + "more", "a b\nc d\na b\n" * 30, 'key token = "11acdfb36bb72224148e6160f674b4be45601bff" end. 4539148803436467', "Ünïcode ßtraße – 日本語 text here", "<|endoftext|> don't 'tis", None]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "one two three", "en", "s1"), (None, None, None, None), (3, "other text of id three", "fr", "s0")]
    # columns whose names the operators might use themselves
    return [(i, t, lang, s, len(t) if t is not None else None, 1, "k", 2.0, "g", 3, "r", 4) for i, t, lang, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, count double, `group` string, salt int, root string, block int"


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder with documents and pages of odd rows."""
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_rows(), SCHEMA).coalesce(2).write.parquet(f"{d}/documents.parquet")
    pages = [(1, "https://A.Example.NET/en/1?x", '<a href="http://b.example.com/">', "h"), (2, None, None, "h"), (3, "no scheme", "<a href=x>", "h"), (4, "http://x.org", "", "h"), (None, "http://x.org/fr/#a", None, None), (1, "https://A.Example.NET/en/1?x", None, "h"), (5, "ftp://net/", "<a href='//spam.net/'>", "h"), (6, "://", None, "h"), (7, "http://Évil.COM/de/", None, "h")]
    spark.createDataFrame(pages, "page_id long, url string, html string, host string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="session")
def empty(spark, odd, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "pages"):
        spark.read.parquet(f"{odd}/{t}.parquet").where("false").write.parquet(f"{d}/{t}.parquet")
    return d
