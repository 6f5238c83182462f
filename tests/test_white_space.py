"""White space in the JVM's patterns."""

from pyspark.sql import functions as F

from inkstone.functions import segment


def test_white_space_of_the_jvm_is_that_of_the_lists(spark):
    c = F.expr("decode(encode(chr, 'UTF-8'), 'UTF-8')")
    signs = spark.createDataFrame([(chr(i),) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000] + [("\U0001f600",)], "chr string").select(c.alias("c")).coalesce(2)
    forms = ["[{}]", "[^{}]", "[^aeiou{}]", "[^A-Za-z0-9_{}]"]
    for form in forms:
        assert signs.filter(F.col("c").rlike(form.format(segment.WS)) != F.col("c").rlike(form.format(segment.SPACE))).count() == 0
    assert signs.filter(F.col("c").rlike(f"[{segment.SPACE}]")).count() == len(segment.WS_CHARS)
