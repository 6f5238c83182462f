"""The web categories come from one reading of the documents."""

from pyspark.sql import functions as F

from inkstone.functions import category_lists as L
from inkstone.functions import segment
from inkstone.operators import categories
from inkstone.operators.lexical import _jvm

TEXTS = ["And so , x ..and .  , (Or) or_ for\n; yet", "Kand but İf soİand canK", "", " ,", "is IS It's are; was-were wäs", "İs generally may. Benefit, useful_ good"]


def test_documents_are_read_once(spark):
    docs = spark.createDataFrame([(1, "Some text here. More of it.")], "doc_id long, text string").repartition(2)
    plan = categories.web_categories(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1


def test_counts_of_words_and_marks_are_those_of_the_patterns(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    words = segment.ascii_words(F.col("text"))
    pairs = [(F.regexp_count("text", _jvm(p)), categories.among(words, categories.listed(p))) for p in (L.QUALIFIED, L.ASSERTIVE, L.FOR, L.AGAINST)]
    pairs += [(F.regexp_count("text", _jvm(p)), F.regexp_count("text", _jvm(q))) for p, q in categories.SAME_COUNT.items()]
    for c in zip(*[[r[i] for r in df.select(*[x for pair in pairs for x in pair]).collect()] for i in range(2 * len(pairs))]):
        assert c[::2] == c[1::2]
