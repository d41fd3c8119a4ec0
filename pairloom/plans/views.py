"""The tables as the engine's inputs: the same views as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.spans import marked
from ..functions.text import squeezed
from ..operators.pairs import sentence_pieces, sentence_rows
from ..schema import LABELS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digit(text: Column) -> Column:
    """A number out of a text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def sql_digit(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Instances of line items: an order is a sentence, a return flag a label."""
    label = F.when(F.col("l_returnflag") == "N", "NONE").when(F.col("l_returnflag") == "A", "ADVISE").otherwise("EFFECT")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("sent_id"), label.alias("label"), F.col("l_linestatus").alias("source"), key.alias("key"))


ORDERS = """inst AS (SELECT CAST(l_orderkey AS VARCHAR) AS sent_id, CASE l_returnflag WHEN 'N' THEN 'NONE' WHEN 'A' THEN 'ADVISE' ELSE 'EFFECT' END AS label,
  l_linestatus AS source, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS key FROM lineitem)"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """orders with a prediction: right for half of the rows, else a label by hash; and the order's size."""
    h = digit(F.concat(F.lit("p:"), "key"))
    other = F.element_at(F.array(*map(F.lit, LABELS)), (F.floor(h / 2) % 5 + 1).cast("int"))
    n = F.count("*").over(Window.partitionBy("sent_id"))
    return orders(spark, d).withColumn("predicted", F.when(h % 2 == 0, F.col("label")).otherwise(other)).withColumn("n_entities", n)


PREDICTIONS = f"""{ORDERS}, pred AS (SELECT *, CASE WHEN h % 2 = 0 THEN label ELSE ['NONE', 'ADVISE', 'EFFECT', 'INT', 'MECHANISM'][CAST(h // 2 % 5 + 1 AS INTEGER)] END AS predicted
  FROM (SELECT *, {sql_digit("'p:' || key")} AS h, count(*) OVER (PARTITION BY sent_id) AS n_entities FROM inst))"""


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Instances of documents: the id is a sentence of its own, labels come from the labels table."""
    label = F.when(F.col("toxic") == 1, "ADVISE").when(F.col("quality") == 1, "EFFECT").otherwise("NONE")
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.select(F.col("doc_id").cast("string").alias("sent_id"), label.alias("label"), F.col("lang").alias("source"), "text", F.lit(0).alias("pair_no"))


DOCUMENTS = """docs AS (SELECT CAST(doc_id AS VARCHAR) AS sent_id, CASE WHEN toxic = 1 THEN 'ADVISE' WHEN quality = 1 THEN 'EFFECT' ELSE 'NONE' END AS label, lang AS source, text
  FROM documents LEFT JOIN labels USING (doc_id))"""

SENTENCES = r"""pieces AS (SELECT doc_id, lang, i - 1 AS s, p[i] AS piece, list_sum(list_transform(p[1:i], lambda x: length(x))) AS e
  FROM (SELECT doc_id, lang, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, lang, regexp_extract_all(text, '[^.!?]+[.!?]*\s*|[.!?]+\s*', 0) AS p FROM documents)))"""

SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentence_rows(table(spark, d, "documents"), keep=("lang",))


def pieces(spark: SparkSession, d: str) -> DataFrame:
    """sentences without offsets."""
    return sentence_pieces(table(spark, d, "documents"), keep=("lang",))


def mentions_in(spark: SparkSession, d: str) -> DataFrame:
    """English sentences of six words and more: words two, four and five of each are its mentions.

    Short sentences go by an explode: a filter would be moved below the words and cut each
    sentence into words a second time.
    """
    s = pieces(spark, d).where("lang = 'en'").select("doc_id", "s", squeezed(F.col("piece")).alias("t"))
    words = F.split("t", " ")
    w = s.select("doc_id", "s", F.explode(F.when(F.size(words) >= 6, F.array(F.struct("t", words.alias("w"))))).alias("x")).select("doc_id", "s", "x.*")
    begin = lambda k: sum((F.length(F.col("w")[i]) + 1 for i in range(k - 1)), F.lit(0))
    span = lambda k: F.struct(begin(k).alias("begin"), (begin(k) + F.length(F.col("w")[k - 1])).alias("end"))
    return w.select(F.concat_ws(":", "doc_id", "s").alias("sent_id"), "t", "w", F.array(span(2), span(4), span(5)).alias("spans"))


def marked_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Marked instances: the three pairs of mentions of each such sentence, labelled by hash."""
    m = mentions_in(spark, d)
    pair = F.explode(F.array(*(F.struct(F.lit(n).alias("pair_no"), F.col("spans")[i].alias("a"), F.col("spans")[j].alias("b"), F.col("w")[x].alias("name1"), F.col("w")[y].alias("name2")) for n, (i, j, x, y) in enumerate([(0, 1, 1, 3), (0, 2, 1, 4), (1, 2, 3, 4)]))))
    p = m.select("sent_id", "t", pair.alias("p")).select("sent_id", "t", "p.*")
    kind = digit(F.concat_ws(":", "sent_id", "pair_no")) % 10
    label = F.when(kind < 6, "NONE").otherwise(F.element_at(F.array(*map(F.lit, LABELS)), (kind - 4).cast("int")))
    text = marked(F.col("t"), F.col("a.begin"), F.col("a.end"), F.col("b.begin"), F.col("b.end"))
    return p.select(text.alias("text"), label.alias("label"), F.lit("en").alias("source"), "sent_id", "pair_no", "name1", "name2")


_PAIR_TEXT = """concat_ws(' ', list_aggregate(w[1:{a} - 1], 'string_agg', ' '), '[E1]' || w[{a}] || '[/E1]', CASE WHEN {b} > {a} + 1 THEN list_aggregate(w[{a} + 1:{b} - 1], 'string_agg', ' ') END,
  '[E2]' || w[{b}] || '[/E2]', list_aggregate(w[{b} + 1:], 'string_agg', ' '))"""
MENTIONS = SENTENCES + r""", longs AS (SELECT CAST(doc_id AS VARCHAR) || ':' || CAST(s AS VARCHAR) AS sent_id, string_split(trim(regexp_replace(piece, '\s+', ' ', 'g')), ' ') AS w FROM pieces WHERE lang = 'en'),
ments AS (SELECT * FROM longs WHERE len(w) >= 6)"""
MARKED = (
    MENTIONS
    + ", three AS ("
    + " UNION ALL ".join(f"SELECT sent_id, {n} AS pair_no, w[{a}] AS name1, w[{b}] AS name2, {_PAIR_TEXT.format(a=a, b=b)} AS text FROM ments" for n, (a, b) in enumerate([(2, 4), (2, 5), (4, 5)]))
    + f"), inst AS (SELECT *, 'en' AS source, CASE WHEN k < 6 THEN 'NONE' ELSE ['NONE', 'ADVISE', 'EFFECT', 'INT', 'MECHANISM'][CAST(k - 4 AS INTEGER)] END AS label FROM (SELECT *, {sql_digit('sent_id || chr(58) || CAST(pair_no AS VARCHAR)')} % 10 AS k FROM three))"
)
