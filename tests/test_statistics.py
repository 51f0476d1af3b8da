from concord.operators import statistics


def test_phrases_of_up_to_sixteen_words_are_counted(spark):
    words = [f"w{chr(97 + k)}" for k in range(20)]
    lines = spark.createDataFrame([(" ".join(words),), (" ".join(words[:6]),), (" ".join(words[:2] * 3),), ("",)], "text string")
    heads = [" ".join(words[:n]) for n in (2, 4, 6, 16, 17)] + ["wb wa", "wa wc", "wc wd we wf wh"]
    got = {r.phrase: r.n for r in statistics.phrase_attestation(lines, spark.createDataFrame([(h,) for h in heads], "phrase string")).collect()}
    assert got == {heads[0]: 5, heads[1]: 2, heads[2]: 2, heads[3]: 1, heads[4]: None, "wb wa": 2, "wa wc": 0, "wc wd we wf wh": 0}
