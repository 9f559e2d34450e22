"""Credit parsing and decisions over the driver's tables: a part's name is a person's, an order's lines are a document's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import credits as C
from .relational import read


def lines(spark: SparkSession, d: str) -> DataFrame:
    """doc, pos and line: heads of roles now and then, names of parts between them."""
    l = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(read(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    head = F.when(F.col("l_partkey") % 5 == 0, "Director").when(F.col("l_partkey") % 7 == 0, "Cast").when(F.col("l_partkey") % 11 == 0, "Guest Stars")
    return l.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("pos"), F.coalesce(head, F.initcap("p_name")).alias("line"))


_L = "SELECT l_orderkey AS doc, l_linenumber * 100000 + l_partkey AS pos, l_partkey AS k, p_name FROM lineitem JOIN part ON l_partkey = p_partkey"


@query(f"""
WITH l AS ({_L}), h AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'director' WHEN k % 7 = 0 THEN 'cast' END AS head, k % 5 <> 0 AND k % 7 <> 0 AND k % 11 = 0 AS guest FROM l),
r AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS role FROM h)
SELECT doc, pos, role FROM r WHERE head IS NULL AND role IS NOT NULL""")
def role_fill(spark: SparkSession, d: str) -> DataFrame:
    """The last head before a line is its role."""
    from pyspark.sql import Window

    l = lines(spark, d).withColumn("h", C.head_of(F.col("line")))
    # two parts of a document may come to one place: then the line decides, so that runs agree
    w = Window.partitionBy("doc").orderBy("pos", "line").rowsBetween(Window.unboundedPreceding, 0)
    return l.withColumn("role", F.last("h", True).over(w)).where("h is null and role is not null").select("doc", "pos", "role")


@query()
def parsed_credits(spark: SparkSession, d: str) -> DataFrame:
    """Names under the heads of roles."""
    return C.parsed_credits(lines(spark, d), "doc", "pos", "line")


#: Heads and cards as credits have them, with % for a name.
FORMS = (
    "Directed by %", "A % FILM", "Réalisé par", "Yönetmen", "% Regie", "Art Director %", "Produced by: %", "YAPIMCI", "% - Produzent", "Line Producer %", "Avec", "OYUNCULAR", "Starring %", "Mit",
    "Director of Photography %", "Director OF PHON %", "A Warner Bros Film", "Directed by % Pictures", "Lead Technical Director", "Directed by the sound and the fury", "", "Un film de %",
)


def credit_lines(spark: SparkSession, d: str) -> DataFrame:
    """doc, pos and line: names of parts among heads of many languages, cards, other roles and blank lines."""
    l = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(read(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"), F.lit(2 * len(FORMS))).cast("int")
    line = F.coalesce(F.replace(F.get(F.array(*map(F.lit, FORMS)), n), F.lit("%"), F.initcap("p_name")), F.initcap("p_name"))
    return l.select(F.floor(F.col("l_orderkey") / 4).alias("doc"), ((F.col("l_orderkey") * 1000 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("pos"), line.alias("line")).distinct()


@query()
def anchored_roles(spark: SparkSession, d: str) -> DataFrame:
    """Names on, after or before a head's line."""
    return C.anchored_roles(credit_lines(spark, d), "doc", "pos", "line")


@query()
def line_directors(spark: SparkSession, d: str) -> DataFrame:
    """The directors that lines name by themselves."""
    from ..operators import rolelexicon as L

    return credit_lines(spark, d).withColumn("director", L.director_name(F.col("line"))).where("director <> ''").groupBy("doc", "director").agg(F.count("*").alias("n"))


@query()
def guest_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Names under a head of guests."""
    return C.guests(lines(spark, d), "doc", "pos", "line")


@query()
def stop_cards(spark: SparkSession, d: str) -> DataFrame:
    """cards and boilerplate blocks dropped."""
    c = C.stop_cards(lines(spark, d), "doc", "pos", "line", "director", "cast", r"^guest (\d+)$")
    return C.without_boilerplate(c, "line").where(~C.noise(F.col("line")))


@query()
def confirmed_cast(spark: SparkSession, d: str) -> DataFrame:
    """Read names kept, corrected, dropped or filled from the known ones."""
    l = lines(spark, d).withColumnRenamed("line", "name")
    known = l.where("pos % 3 != 0")
    return C.confirmed_cast(l.where("pos % 2 = 0"), known, l.where("pos % 5 = 0"), "doc")


@query()
def suspect_names(spark: SparkSession, d: str) -> DataFrame:
    """Read names without any witness."""
    l = lines(spark, d).withColumnRenamed("line", "name").select("doc", "name")
    return C.unsigned(l, l.where(F.length("name") % 2 == 0), l.where(F.length("name") % 3 == 0), "doc", F.lit(True))


@query()
def unwitnessed_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that no witness matches."""
    l = lines(spark, d).withColumnRenamed("line", "name").select("doc", "name").distinct()
    return C.unwitnessed(l, l.where(F.length("name") % 2 == 0), "doc")


@query()
def consensus_lines(spark: SparkSession, d: str) -> DataFrame:
    """The line that most often spells a name."""
    l = lines(spark, d)
    names = l.select("doc", F.col("line").alias("name")).distinct()
    return C.consensus_line(names, l, "doc", "name", "line")


@query("""
WITH v AS (SELECT l_orderkey AS doc, l_linenumber % 3 AS src, l_returnflag AS val FROM lineitem), c AS (SELECT doc, val, count(DISTINCT src) AS n FROM v GROUP BY 1, 2),
r AS (SELECT *, coalesce(lead(n) OVER w, 0) AS nxt, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY doc ORDER BY n DESC, val))
SELECT doc, val, n, CASE WHEN n = nxt THEN 'CONFLICT' WHEN n >= 2 THEN 'CONFIRMED' ELSE 'SINGLE' END AS verdict FROM r WHERE k = 1""")
def source_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The value that most independent sources give."""
    v = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 3).alias("src"), F.col("l_returnflag").alias("val"))
    return C.sources_agree(v, "doc", "src", "val")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'read' WHEN o_custkey % 4 = 0 AND o_orderkey % 4 >= 2 THEN 'filled' WHEN o_orderstatus = 'O' AND o_orderkey % 4 >= 2 THEN 'replaced' ELSE 'unread' END AS source FROM orders""")
def director_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Read, filled, replaced or unread."""
    o = read(spark, d, "orders")
    read_name = F.when(F.col("o_custkey") % 4 == 0, "").otherwise("x")
    verdict = F.when(F.col("o_orderstatus") == "F", "CONFIRMED").when(F.col("o_orderstatus") == "O", "CONFLICT").otherwise("NONE")
    return o.select("o_orderkey", C.director_decision(read_name, verdict, F.col("o_orderkey") % 4, F.lit("k"))["source"].alias("source"))


@query("""
WITH c AS (SELECT l_orderkey AS doc, l_partkey AS film, l_linenumber = 2 AS t, l_quantity > 45 AS c, l_discount > 0.08 AS y FROM lineitem),
a AS (SELECT doc, sum(t::INT) AS nt, sum(c::INT) AS nc, sum(y::INT) AS ny, count(*) AS n, max(CASE WHEN t THEN film END) AS ft, max(CASE WHEN c THEN film END) AS fc, max(CASE WHEN y THEN film END) AS fy, max(film) AS f FROM c GROUP BY 1)
SELECT doc, CASE WHEN nt = 1 THEN ft WHEN nc = 1 THEN fc WHEN n = 1 THEN f WHEN ny = 1 THEN fy END AS film, CASE WHEN nt = 1 OR nc = 1 THEN 'strong' ELSE 'weak' END AS tier FROM a WHERE nt = 1 OR nc = 1 OR n = 1 OR ny = 1""")
def director_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The only film of a director that fits."""
    c = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("film"), "l_linenumber", "l_quantity", "l_discount")
    return C.director_anchor(c, "doc", F.col("l_linenumber") == 2, (F.col("l_quantity") > 45).cast("int"), F.col("l_discount") > 0.08, "film")


@query("""
SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'broken:BROKEN_X' WHEN p_partkey % 4 = 0 AND p_size % 5 = 0 THEN 'nothing_read' WHEN p_partkey % 4 = 0 AND p_size % 5 <= 3 THEN 'few_cards' END AS reason FROM part""")
def fallback_needs(spark: SparkSession, d: str) -> DataFrame:
    """Why a document must be read again."""
    s = F.when(F.col("p_size") % 9 == 0, "BROKEN_X").otherwise("OK")
    return read(spark, d, "part").select("p_partkey", C.fallback_need(s, F.col("p_partkey") % 4, F.col("p_size") % 5).alias("reason"))


@query("""
SELECT doc_id, CASE WHEN lang = 'de' THEN 'DOCUMENTARY' WHEN lang = 'fr' THEN 'MUSIC' ELSE 'OTHER' END AS genre FROM documents""")
def genre_classes(spark: SparkSession, d: str) -> DataFrame:
    """The first special genre that a field names."""
    a = F.when(F.col("lang") == "de", "Belgesel")
    b = F.when(F.col("lang") == "fr", "live Concert")
    return read(spark, d, "documents").select("doc_id", C.genre_class(a, b).alias("genre"))


@query(r"""
WITH t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)', '\1THE\2', 'g'), '(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)', '\1THE\2', 'g') AS text FROM conversations)
SELECT conv_id, turn, sha256(text) AS text FROM t""")
def lexicon_terms(spark: SparkSession, d: str) -> DataFrame:
    """Whole words replaced by their canonical form."""
    return read(spark, d, "conversations").select("conv_id", "turn", F.sha2(F.encode(C.lexicon_replace(F.col("text"), [("(?-i:the)", "THE")]), "utf-8"), 256).alias("text"))


@query()
def text_variants(spark: SparkSession, d: str) -> DataFrame:
    """The variant whose markers weigh most."""
    m = {"en": [("the", 2), ("of", 1)], "de": [("und", 2), ("der", 1)], "fr": [("le", 2), ("de", 1)]}
    return read(spark, d, "documents").select("doc_id", C.variant_scores(F.col("text"), m, "none").alias("variant"), C.garbled(F.col("text")).alias("garbled"))


#: People, the last two near others, and how they are read now and then.
PEOPLE = ("Anna Karen", "Boris Vogel", "Carla Monti", "Dario Penn", "Elena Sand", "Fritz Oberon", "Greta Holm", "Hugo Brandt", "Irena Kovac", "Jonas Weller", "Anna Karon", "Boris Vogell")


def _person(k: Column) -> Column:
    return F.get(F.array(*map(F.lit, PEOPLE)), F.pmod(k, F.lit(len(PEOPLE))).cast("int"))


def readings(spark: SparkSession, d: str) -> DataFrame:
    """doc, model, pos, name: what three models read as an order's directors, misread where a part's number ends in 3."""
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_linenumber", "l_partkey", "l_suppkey").distinct()
    right = _person(F.floor(F.col("doc") / 3) + F.when(F.col("l_partkey") % 4 == 0, F.col("l_suppkey")).otherwise(0))
    name = F.when(F.col("l_partkey") % 10 == 3, F.concat(F.left(right, F.lit(2)), F.upper(F.substring(right, 3, 1)), F.expr("substring(r, 5)"))).otherwise(right)
    return l.withColumn("r", right).select("doc", (F.col("l_partkey") % 3).alias("model"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"), name.alias("name")).where("pos % 5 <> 4")


def known_people(spark: SparkSession, d: str) -> DataFrame:
    """name and ok: of the people that suppliers stand for, which the base has as directors, and which in other roles."""
    s = read(spark, d, "supplier").select((F.col("s_suppkey") % len(PEOPLE)).alias("k")).distinct()
    return s.where("k NOT IN (4, 7)").select(_person(F.col("k")).alias("name"), (F.col("k") % 5 != 1).alias("ok"))


def director_sources(spark: SparkSession, d: str) -> DataFrame:
    """doc, source, pos, name, independent: three sources of an order's director, some without one, some with another."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), "o_custkey")
    k = F.floor(F.col("doc") / 3)
    one = lambda name, gone, other, sure: o.where(f"o_custkey % {gone} <> 0").select("doc", F.lit(name).alias("source"), F.lit(0).alias("pos"), _person(k + F.when(F.col("o_custkey") % other == 1, 2).otherwise(0)).alias("name"), sure.alias("independent"))
    return one("a", 3, 7, F.lit(True)).unionByName(one("b", 4, 5, F.col("o_custkey") % 2 == 0)).unionByName(one("c", 5, 11, F.col("o_custkey") % 3 == 0))


@query()
def fused_directors(spark: SparkSession, d: str) -> DataFrame:
    """The directors that models' readings come to: agreed, known, canonical, single or unread."""
    from ..operators import verdicts

    return verdicts.fused(readings(spark, d), known_people(spark, d), "doc").select("doc", F.array_join("names", "; ").alias("names"), "how")


@query()
def validated_directors(spark: SparkSession, d: str) -> DataFrame:
    """Read directors held against sources, of which only independent ones count and one dissent is absorbed."""
    from ..operators import verdicts

    v = verdicts.validated(readings(spark, d).where("model = 0").select("doc", "pos", "name"), director_sources(spark, d), "doc")
    return v.select("doc", *[F.array_join(c, "; ").alias(c) for c in ("names", "confirmed_by", "candidates")], "status", "confidence")


@query()
def quality_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Fusion, validation and the cast's confirmation as one verdict."""
    from ..operators import verdicts

    l = lines(spark, d).withColumnRenamed("line", "name")
    b = verdicts.quality_block(readings(spark, d), known_people(spark, d), director_sources(spark, d), l.where("pos % 2 = 0"), l.where("pos % 3 != 0"), l.where("pos % 5 = 0"), "doc", 2)
    return b.withColumn("directors", F.array_join("directors", "; "))


def entity_rules() -> tuple:
    """Names after words that the conversations have, in several spellings."""
    from ..operators.entities import RULES, Rule

    return (*RULES, Rule("The House", ("the", "thé"), "organization"), Rule("Elle", ("elle", "ele"), "person"), Rule("New Tion", ("tion",), "place"), Rule("Und", ("UND", "unt"), "other"))


@query()
def entity_spans(spark: SparkSession, d: str) -> DataFrame:
    """Names put right by a lexicon of several entries, with the evidence of what was found where."""
    from ..operators import entities

    e = entities.normalised(read(spark, d, "conversations").select("conv_id", "turn", "text"), "text", entity_rules())
    spans = F.transform("entities", lambda x: F.concat_ws(":", x["canonical"], x["matched"], x["start"], x["end"]))
    return e.select("conv_id", "turn", F.sha2(F.encode(F.coalesce("normalized_text", "text"), "utf-8"), 256).alias("text"), F.size("entities").alias("n"), F.sha2(F.encode(F.array_join(spans, ","), "utf-8"), 256).alias("spans"))
