import hashlib
import random
import re
import unicodedata
import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reviewmill.functions import ids
from reviewmill.functions import text as X
from reviewmill.plans.preprocess import preprocess_reviews

ENTITIES = dict(amp="&", lt="<", gt=">", quot='"', apos="'") | {"#39": "'"}
PIECES = [*"ab .@-+<>&;09 1(2)3_\x1c\t\n", "ß", "İ", "Σ", "ς", "é", "＜", "①", "½", "&amp;", "lt;", "&lt;", "www.",
          "http://", "x@y.co", "+90 212 555 01 02", "ﬁ", " ", "‍", "‿", "٣", "Ⅷ", "अि", "Ꭰ", "ꭰ"]


def expected(text: str) -> tuple[str, str]:
    """Brute force over one string: (masked, folded)."""
    clean = re.sub(r"<[^>]+>", " ", unicodedata.normalize("NFKC", text))
    clean = re.sub("&(" + "|".join(map(re.escape, ENTITIES)) + ");", lambda m: ENTITIES[m[1]], clean)
    clean = " ".join(re.sub(r"(?i)(?:https?://|www\.)\S+", " ", clean).split())
    clean = re.sub(r"[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}", "[EMAIL]", clean)
    clean = re.sub(r"(?<!\w)(\+?\d[\d\s().-]{7,}\d)(?!\w)", "[PHONE]", clean)
    return clean, clean.casefold()


def test_preprocess_matches_brute_force_on_odd_strings(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 25))) for _ in range(3000)]
    texts += ["a@b.com.x@d.org", "&amp;lt;b&amp;gt;", "ok", "  <p></p>  ", "x" * 5000 + "@", "Straße é@ü.de 12345678901"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for row in preprocess_reviews(df).collect():
        masked, folded = expected(texts[row.i])
        assert (row.text_redacted, row.text_normalized) == (masked, folded), ascii(texts[row.i])
        assert row.content_hash == hashlib.sha256(folded.encode()).hexdigest()
        assert row.is_meaningful == (len(masked) >= 3)
        assert row.language == "und"


def test_pieces(spark):
    row = spark.sql("select 'Tea<i>pot</i>&lt;3' as a, ' www.kettle.test/lid\ttwo \n spouts' as b").select(
        X.strip_html("a").alias("a"), X.normalize_text("b").alias("b"), X.nfkc(F.lit(None).cast("string")).alias("n")
    ).first()
    assert tuple(row) == ("Tea pot <3", "two spouts", None)


def test_uuid7(spark):
    made = spark.range(50).select(
        ids.uuid7(F.lit(1700000000123), F.col("id")).alias("a"),
        ids.uuid7(F.lit(1700000000123), F.col("id")).alias("again"),
        ids.uuid7(F.lit(1700000000123)).alias("b"),
    )
    rows = made.withColumn("ms", ids.uuid7_millis("b")).collect()
    assert all(r.a == r.again and r.ms == 1700000000123 for r in rows)
    assert len({r.a for r in rows}) == 50
    assert all(uuid.UUID(r.b).version == 7 and uuid.UUID(r.a).variant == uuid.RFC_4122 for r in rows)
    with pytest.raises(PySparkException):
        spark.range(1).select(ids.uuid7_millis(F.lit(str(uuid.uuid4())))).collect()


def test_texts_without_a_match_skip_patterns_with_equal_results(spark):
    texts = ["WWW.x.org y", "wwW.a wWw.b", "HTTPS://d e", "httpſ://q r", "http:/x www", "< & @ 1", "a <b>x</b> &lt;", "&amp;lt;", "a@b.cd", "tel +49 (0) 123-456 789", "٠١٢٣٤٥٦٧٨٩ x", "plain", "é", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    entities = F.regexp_replace("text", X.TAG_PATTERN, " ")
    for entity, char in X.ENTITIES.items():
        entities = F.replace(entities, F.lit(entity), F.lit(char))
    plain = {
        X.strip_html: entities,
        X.strip_urls: F.regexp_replace("text", X.URL_PATTERN, " "),
        X.mask_email: F.regexp_replace("text", X.EMAIL_PATTERN, X.EMAIL_MASK),
        X.mask_phone: F.regexp_replace("text", X.PHONE_PATTERN, X.PHONE_MASK),
    }
    for step, whole in plain.items():
        assert all(r.got == r.want for r in df.select(step("text").alias("got"), whole.alias("want")).collect())
        # before, every text went through the pattern
        assert "CASE WHEN" in str(step("text")) or "when" in str(step("text")).lower()
