import pytest

WORDS = "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


@pytest.fixture(scope="session")
def corpus(spark):
    """doc_id, text, lang, source with nulls, empty, long, repeated and near rows."""
    import random

    rng, rows = random.Random(7), []
    for i in range(300):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 120))).capitalize() + "."
        rows.append((i, text, "en", f"s{i % 5}"))
    rows += [(300, None, "en", None), (301, "", None, "s1"), (302, " \n\t", "de", "s2"), (303, rows[0][1], "en", "s0"), (303, rows[0][1], "en", "s0"), (304, rows[1][1].upper(), None, "s0"), (305, "word " * 30_000, "en", "s3"), (None, "no id here", "en", "s4"), (306, "é 中文  x", "zh", "s4")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()
