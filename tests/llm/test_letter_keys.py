"""Keys without a digit are secrets too; words and identifiers are not."""

import random

from pyspark.sql import functions as F

from evidentia.llm import secrets

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def test_random_letters_are_told_from_words(spark):
    rng = random.Random(7)
    keys = ["".join(rng.choice(LETTERS) for _ in range(n)) for n in (20, 24, 32, 40) for _ in range(100)]
    words = ["getUserNameFromDatabaseConnection", "AbstractSingletonProxyFactoryBean", "donaudampfschifffahrtsgesellschaft", "Path/To/Some/Other/Folder", "THE_MAXIMUM_NUMBER_OF_ROWS", "file-name-without-digits", "a" * 40, "aB" * 20]
    found = {r.t: r.hit for r in spark.createDataFrame([(t,) for t in keys + words], "t string").select("t", secrets.entropy_secret(F.col("t")).alias("hit")).collect()}
    assert sum(found[k] for k in keys) > 0.9 * len(keys) and not any(found[w] for w in words)
    text = spark.createDataFrame([(1, f"see {keys[-1]} there")], "doc_id int, text string")
    assert secrets.redact(secrets.scan_secrets(text)).first().text == "see [SECRET] there"
