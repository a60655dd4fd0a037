"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are runs of 12 key characters or more with a digit or a vendor's prefix, web tokens with their parts in one,
values of 6 characters or more assigned to a credential's name, and private key blocks. The forest sees, of each candidate, its length, the transitions between classes of
characters, how much of it a dictionary covers, the path (here: source) it comes from and the words beside it, and was
trained on labelled findings. Candidates have no greatest length. Everything is made of DataFrame functions and the JVM's forest.

Defined results: a null or empty text has no candidates; a candidate that a document has several times in the same
surroundings is several rows; repeated rows repeat; an empty table gives an empty result; a null source is an
unknown path; extra columns are not looked at by the scan, and kept by redaction.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import spare

#: Names of credentials, words beside things that only look like them, parts of placeholders.
CREDENTIALS = "passwords?|passwd|passwort|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credentials?"
LOOKALIKES = "commit|sha1|sha256|md5|checksum|digest|etag|uuid|guid|isbn|order|invoice|card|phone|serial|version|revision|id"
DICTIONARY = "example|changeme|placeholder|password|secret|token|sample|dummy|test|your|here|insert|key|user|name|default|null|none|true|false|section|chapter|introduction|image|index|main|release|version|report|table|figure|number"
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk_live_|rk_live_|xox[abprs]-|AIza|glpat-|npm_|eyJ[A-Za-z0-9]"
VENDORS = f"{PREFIXES}|-----BEGIN"

_KEY = r"A-Za-z0-9+/_\-"
#: A quote, which may be escaped, and white space with at most one line break: open, and never given back.
_QUOTE, _GAP = r"(?:\\*+[\"'])?+", r"[ \t]*+\s{0,2}+[ \t]*+"
_SIGN = r"(?:=>|:=|[=:])"
#: What stands before a value that is assigned to a credential's name, and stays outside the candidate.
_NAMED = rf"(?i:{CREDENTIALS}){_QUOTE}{_GAP}{_SIGN}{_GAP}{_QUOTE}"
#: A private key: from its BEGIN line to the END line, whatever is between but another such line.
_BLOCK = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-(?!----(?:BEGIN|END) [A-Z0-9 ]*PRIVATE KEY)[^-]*+)*+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
BODY = (
    rf"{_NAMED}(?:{_BLOCK}|(?:[^\s\"',;\\]|\\(?!\\*+[\"'])){{6,}}+)"
    rf"|(?<![A-Za-z0-9])eyJ[{_KEY}]{{4,}}+\.[{_KEY}]{{4,}}+(?:\.[{_KEY}]*+)?+"
    rf"|(?<![{_KEY}])(?=[A-Za-z+/_\-]*+[0-9])[{_KEY}]{{12,}}+={{0,2}}"
    rf"|(?<![A-Za-z0-9])(?={PREFIXES})[{_KEY}]{{12,}}+={{0,2}}"
    rf"|{_BLOCK}"
)

FEATURES = ["length", "digits", "upper", "lower", "hex", "distinct", "transitions", "vendor", "dictionary", "test_path", "config_path", "credential", "lookalike", "assigned", "quoted", "right_word"]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, ordinal, left, candidate, right: one row a candidate, in the order of the text.

    The text is split at the candidates, so that the pieces around one end and begin with what stands beside it: one
    pass over every text and two more over those that have a candidate, however long.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), text.alias("text")).filter(F.col("text").rlike(BODY))
    beside = F.transform(F.split("text", BODY), lambda x: F.struct(F.right(x, F.lit(32)).alias("end"), F.left(x, F.lit(24)).alias("start")))
    found = rows.select("doc_id", "path", F.regexp_extract_all("text", F.lit(f"({BODY})"), F.lit(1)).alias("c"), beside.alias("b"))
    one = found.select("doc_id", "path", "b", F.posexplode("c").alias("ordinal", "c"))
    before, after = F.get("b", F.col("ordinal"))["end"], F.get("b", F.col("ordinal") + 1)["start"]
    named = F.regexp_extract("c", f"^({_NAMED})", 1)
    left = F.regexp_extract(F.concat(before, named), r"([^\n]*)$", 1)
    return one.select("doc_id", "path", "ordinal", left.alias("left"), F.substring("c", F.length(named) + 1, F.length("c")).alias("candidate"), F.regexp_extract(after, r"^([^\n]*)", 1).alias("right"))


def share(c: Column, pattern: str) -> Column:
    """The share of characters that match."""
    return F.length(F.regexp_replace(c, f"[^{pattern}]", "")) / F.greatest(F.length(c), F.lit(1))


def featured(rows: DataFrame) -> DataFrame:
    """Adds the columns of FEATURES to rows with left, candidate, right and path."""
    c, left, path = F.col("candidate"), F.lower("left"), F.lower(F.coalesce("path", F.lit("")))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "l"), "[A-Z]+", "U"), "[0-9]+", "9"), r"[^lU9]+", "-")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return rows.withColumns({
        "length": F.log1p(F.length(c)),
        "digits": share(c, "0-9"),
        "upper": share(c, "A-Z"),
        "lower": share(c, "a-z"),
        "hex": flag(c.rlike("^[a-f0-9]*[a-f][a-f0-9]*$")),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.greatest(F.length(c), F.lit(1)),
        "transitions": (F.length(kinds) - 1) / F.greatest(F.length(c) - 1, F.lit(1)),
        "vendor": flag(c.rlike(f"^(?:{VENDORS})")),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(c), f"(?:{DICTIONARY})", "")) / F.greatest(F.length(c), F.lit(1)),
        "test_path": flag(path.rlike("(?:^|[/._-])(?:tests?|docs?|examples?|samples?|fixtures?)(?:[/._-]|$)")),
        "config_path": flag(path.rlike(r"\.(?:env|cfg|conf|ini|ya?ml|json|properties|tfvars|pem)$|(?:^|/)(?:config|secrets?)")),
        "credential": flag(left.rlike(f"(?:^|[^a-z])[a-z_-]{{0,16}}(?:{CREDENTIALS})\\\\*[\"']{{0,1}}\\s*(?:{_SIGN}|is\\s|\\s)\\s*\\\\*[\"']{{0,1}}$")),
        "lookalike": flag(left.rlike(f"(?:^|[^a-z])(?:{LOOKALIKES})[\"']{{0,1}}\\s{{0,3}}[=:#]{{0,1}}\\s{{0,3}}[\"']{{0,1}}$")),
        "assigned": flag(left.rlike(f"{_SIGN}\\s*\\\\*[\"']{{0,1}}$")),
        "quoted": flag(left.rlike("[\"']$")),
        "right_word": flag(F.col("right").rlike("^[\"',.;]{0,2}\\s+\\p{L}+")),
    })


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """n findings with labels, each made from the digest of its number: left, candidate, right, path, label.

    Findings of a real review have the same columns and can be used instead.
    """
    h = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 512)
    dense = lambda salt, k: F.substring(F.regexp_replace(F.base64(F.unhex(h(salt))), "[+/=]", "x"), 1, k)
    hexed = lambda salt, k: F.substring(h(salt), 1, k)
    digits = lambda salt, k: F.substring(F.translate(h(salt), "abcdef", "135790"), 1, k)
    vary = lambda salt, lo, hi: F.lit(lo) + F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(hi - lo + 1)).cast("int")
    upper = lambda salt, k: F.substring(F.upper(F.regexp_replace(F.base64(F.unhex(h(salt))), "[+/=01]", "7")), 1, k)
    word = F.element_at(F.array(*map(F.lit, ["the ", "und ", "que ", "of that ", "de la ", "see ", "Then, ", ""])), vary("w", 1, 8))
    say = lambda *options: F.concat(word, F.element_at(F.array(*map(F.lit, options)), vary("s", 1, len(options))))
    kinds = [
        (1, word, F.concat(F.lit("AKIA"), upper("a", 16))),
        (1, say("aws_access_key_id=", "key: ", 'AWS_KEY="'), F.concat(F.lit("AKIA"), upper("b", 16))),
        (1, say("", "token: ", "GITHUB_TOKEN="), F.concat(F.lit("ghp_"), dense("c", 36))),
        (1, say("", "stripe = '", "secret: "), F.concat(F.lit("sk_live_"), dense("d", 24))),
        (1, say("", "slack_token="), F.concat(F.lit("xoxb-"), digits("e", 12), F.lit("-"), dense("f", 24))),
        (1, say("password=", "password: ", "pwd=", "passwd = '", 'db_password="'), hexed("g", vary("g", 12, 24))),
        (1, say("password=", "password: ", "pwd=", "secret="), dense("h", vary("h", 8, 20))),
        (1, say('token = "', "token=", 'auth_token: "', "Bearer ", 'api_key = "', "api-key: "), hexed("i", 40)),
        (1, say('secret = "', 'api_key="', "client_secret: "), dense("j", vary("j", 24, 64))),
        (1, say("", "Authorization: Bearer "), F.concat(F.lit("eyJ"), dense("k", 33), F.lit("_"), dense("l", 40))),
        (1, say("", "Authorization: Bearer ", "token="), F.concat(F.lit("eyJ"), dense("v2", 30), F.lit("."), dense("w2", vary("w2", 40, 80)), F.lit("."), dense("x2", 43))),
        (1, word, F.concat(F.lit("-----BEGIN PRIVATE KEY-----"), dense("m", 64), F.lit("-----END PRIVATE KEY-----"))),
        (1, word, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.repeat(F.concat(dense("r2", 64), F.lit("\n")), vary("r2", 4, 24)), F.lit("-----END RSA PRIVATE KEY-----"))),
        (1, say("password=", 'password": "', "pwd: "), F.concat(F.translate(hexed("s2", vary("s2", 4, 8)), "0123456789", "eeaioutnrs"), digits("t2", 1), F.element_at(F.array(*map(F.lit, "!@#$")), vary("t2", 1, 4)), F.translate(hexed("u2", vary("u2", 2, 5)), "0123456789", "eeaioutnrs"))),
        (1, word, F.concat(F.lit("AKIA"), F.translate(upper("n2", 16), "23456789", "QWRTZPSD"))),
        (0, say("", "card ", "Karte ", "no. "), F.concat(F.lit("4"), digits("n", 15))),
        (0, say("", "order ", "invoice #", "serial: "), digits("o", vary("o", 12, 20))),
        (0, say("commit ", "revision ", "sha1: ", "commit=", ""), hexed("p", 40)),
        (0, say("sha256:", "checksum: ", "etag: ", "digest = \"", ""), hexed("q", 64)),
        (0, say("md5 ", "md5: ", "id: ", "id=\""), hexed("r", 32)),
        (0, say("uuid: ", "id=", ""), F.concat(hexed("s", 8), F.lit("-"), hexed("t", 4), F.lit("-4"), hexed("u", 3), F.lit("-a"), hexed("v", 3), F.lit("-"), hexed("x", 12))),
        (0, say("password=", "token: ", 'api_key = "', "secret="), F.concat(F.element_at(F.array(*map(F.lit, ["changeme", "your_token_here", "example_key", "placeholder", "your-secret-key", "test_password"])), vary("y", 1, 6)), digits("y", vary("z", 0, 3)))),
        (0, word, F.concat(F.lit("section_"), digits("a2", 1), F.lit("_introduction_"), digits("b2", 2))),
        (0, word, F.concat(F.lit("20"), digits("c2", 2), F.lit("-01-"), digits("d2", 2), F.lit("T10"), digits("e2", 4))),
        (0, word, F.concat(F.lit("src/main/"), F.translate(hexed("f2", 8), "0123456789", "ghijklmnop"), F.lit("/index"), digits("g2", 1))),
        (0, word, F.concat(F.translate(hexed("h2", vary("h2", 12, 28)), "0123456789", "eeaioutnrs"), digits("i2", 1))),
        (0, word, F.concat(F.upper(F.translate(hexed("j2", vary("j2", 12, 28)), "0123456789", "eeaioutnrs")), digits("k2", 1))),
        (0, word, F.concat(F.lit("ASIA-"), F.upper(F.translate(hexed("o2", vary("o2", 4, 10)), "0123456789", "eeaioutnrs")), F.lit("-"), F.upper(F.translate(hexed("p2", vary("p2", 4, 10)), "0123456789", "eeaioutnrs")))),
        (0, word, F.concat(F.lit("npm_config_"), F.translate(hexed("q2", vary("q2", 4, 16)), "0123456789", "eeaioutnrs"))),
        (0, say("ISBN ", "phone ", "+", "DE"), F.concat(digits("l2", 3), F.lit("-"), digits("m2", vary("m2", 8, 12)))),
    ]
    pick = F.element_at(F.array(*(F.struct(F.lit(y).alias("label"), left.alias("left"), c.alias("candidate")) for y, left, c in kinds)), (F.pmod("id", F.lit(len(kinds))) + 1).cast("int"))
    paths = F.element_at(F.array(*map(F.lit, ["src1", "src7", "web", "app/config.yml", "deploy/.env", "tests/test_login.py", "docs/setup.md"])), vary("path", 1, 7))
    right = F.element_at(F.array(*map(F.lit, [" and the", '" thshing', ".", ", then", "", "' of", " la maison"])), vary("right", 1, 7))
    return spark.range(n, numPartitions=2).select(pick.alias("f"), right.alias("right"), paths.alias("path")).select("f.*", "right", "path")


def train(findings: DataFrame, trees: int = 30, depth: int = 9, seed: int = 5) -> PipelineModel:
    """A forest over labelled findings (left, candidate, right, path, label)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(findings).withColumn("label", F.col("label").cast("double")))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label", subsamplingRate=0.8)
    return forest.fit(rows.select("features", "label"))


def scored(rows: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """Adds score and is_secret to candidates."""
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(rows))
    judged = model.transform(assembled).withColumn("score", vector_to_array("probability")[1])
    return judged.select(*rows.columns, F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("is_secret"))


def findings(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, path, ordinal, left, candidate, right, score, is_secret: every candidate of every text."""
    labelled = labelled if labelled is not None else labelled_findings(docs.sparkSession)
    return scored(candidates(docs), train(labelled))


def secret_report(docs: DataFrame) -> DataFrame:
    """The findings without their secrets: doc_id, ordinal, length, masked, candidate_sha256, score, is_secret."""
    masked = F.concat(F.substring("candidate", 1, 4), F.lit("…"))
    return findings(docs).select("doc_id", "ordinal", F.length("candidate").alias("length"), masked.alias("masked"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def redact(docs: DataFrame, labelled: DataFrame | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by ``mark``; n_chars, if there, is the length of the new text.

    Rows that share a doc_id are masked with the secrets of all of them; null texts stay null.
    """
    doc, found = spare(docs, "doc", "found")
    secrets = findings(docs, labelled).filter("is_secret").groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("candidate").alias(found))
    secrets = secrets.withColumn(found, F.array_sort(found, lambda a, b: F.length(b) - F.length(a)))
    joined = docs.join(secrets, docs["doc_id"].cast("long").eqNullSafe(secrets[doc]), "left")
    clean = F.when(F.col(found).isNull(), F.col("text")).otherwise(F.aggregate(found, F.col("text").cast("string"), lambda t, s: F.replace(t, s, F.lit(mark))))
    change = {"text": clean}
    if "n_chars" in docs.columns:
        change["n_chars"] = F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length(clean)).cast(docs.schema["n_chars"].dataType)
    return joined.withColumns(change).select(*docs.columns)
