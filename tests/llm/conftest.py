import pytest

#: Awkward documents: null and empty texts, repeated rows, ties, long and non-Latin texts.
ROWS = [
    (0, "alpha beta gamma delta epsilon zeta eta theta", "en", "s0"),
    (1, None, "en", "s0"),
    (2, "", None, None),
    (3, "alpha beta gamma delta epsilon zeta eta theta", "fr", "s1"),
    (3, "alpha beta gamma delta epsilon zeta eta theta", "fr", "s1"),
    (4, " \t\n", "en", "s1"),
    (5, "one", "en", "s1"),
    (6, "ÉTÉ naïve Straße\nΣΑΣ  日本語 テスト́ <|endoftext|> x\u0085y   z", "de", "s0"),
    (7, "word " * 30_000 + "end", "en", "s0"),
    (9, "don't 12 34.5 it's\r\n\r\nfoo  bar\tbaz ", "en", "s0"),
    (None, "alpha beta gamma delta epsilon zeta eta theta", "en", "s0"),
    (11, "\u0000 \x1c\x1f 😀👩‍👩‍👧", "es", "s0"),
]
#: Names that operators make, or use inside.
CLASHING = ["score", "lang_pred", "held_out", "p_toxic", "p_low_quality", "toxic", "__text", "r", "i", "t", "n", "th", "cls", "row", "id", "size", "group", "shard", "slot", "bucket", "first", "unit", "dice", "license", "n_tokens", "ids", "crcs", "chunk", "piece", "start", "offset", "length", "sequence_id", "file", "payload", "frames", "media", "feature", "s", "next_s", "edited", "after", "fingerprint", "n_shingles", "component_id", "copies", "words"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, h long, part int, " + ", ".join(f"{c} int" for c in CLASHING)


@pytest.fixture(scope="session")
def awkward(spark):
    """With extra columns whose names operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 3, *range(len(CLASHING))) for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
