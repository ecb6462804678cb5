"""Secret scans: candidates by pattern, false positives removed by a random forest.

Everything is a DataFrame operation: candidates come from a regular expression, their features from
built-in functions, and the forest is Spark's own, trained on labelled findings.  Without findings of
one's own, `labelled_findings` makes some by rule: formats of known credentials, random strings
and passwords beside words like `password` or in URLs, against digests, identifiers, numbers and placeholders.

Cases: null and empty texts have no candidates; a candidate that stands more than once in a text is
judged at every place by its own neighbours, and is one finding with the highest score and all its places; an empty table gives an empty result; the
secret itself is not in the result, only a masked form and its digest.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECRET_WORDS = r"(?i)(secret|token|passw(or)?d|pwd|passphrase|api[_ -]?key|apikey|access[_ -]?key|auth|bearer|credential|private[_ -]?key)"
#: A secret word and the rest of its name.
_NAMED = "(?i:" + SECRET_WORDS.removeprefix("(?i)").replace("(", "(?:") + r")[\w.-]{0,20}"
#: What may be a secret: blocks of private keys; the password of an URL; a web token with its signature; what stands in quotes or is
#: assigned after a secret word, marks included; a run of 12 or more characters of keys with a digit; letters of changing case, or many.
CANDIDATE = "|".join((
    r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:[\s\S]{0,8000}?-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----)?",
    r"(?<=:)(?<=://[^\s/:@\"'<>]{0,64}:)[^\s/@\"'<>]{1,200}(?=@)",
    r"(?<![A-Za-z0-9+/_-])eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}(?:\.[A-Za-z0-9_-]*)?",
    rf"(?<=[\"'`])(?<={_NAMED}[^\n\"'`\w]{{0,4}}[\"'`]?[^\n\"'`\w]{{0,8}}([\"'`]))(?:(?!\1)[^\n]){{4,200}}(?=\1)",
    rf"(?<=[=:\s])(?<=[=:]\s{{0,3}}|[Rr]\s{{1,3}})(?<={_NAMED}[\"'`]?\s{{0,3}}[=:]{{1,2}}>?\s{{0,3}}|(?i:bearer)\s{{1,3}})(?!(?i:bearer|basic)\s)[^\s\"'`,;]{{3,199}}[^\s\"'`,;.)\]}}]",
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{12,}={0,2}",
    r"(?<![A-Za-z0-9+/_-])(?:(?=(?:[A-Z+/_-]*[a-z][a-z+/_-]*[A-Z]){2})[A-Za-z+/_-]{16,}|[A-Za-z]{20,}(?![A-Za-z0-9+/_-]))",
))
#: Characters before a candidate in which neighbouring words are looked for, and after it.
BEFORE, AFTER = 48, 16
#: How well-known credentials begin.
PREFIXES = r"^(AKIA|ASIA|AIza|eyJ|gh[pousr]_|github_pat_|glpat-|hf_|npm_|pypi-|sk-|sk_live_|rk_live_|xox[abpr]-)"
HARMLESS_WORDS = r"(?i)(commit|sha-?(1|256|512)?|md5|checksum|digest|uuid|guid|version|revision|hash|etag|build|order|invoice|phone|isbn|example|sample|placeholder|dummy|test)"
PLACEHOLDERS = r"(?i)(your|change|example|placeholder|dummy|none|null|true|false|required|optional|<.*>|\$\{|\{\{|%\(|\*{3}|xxx|\.\.\.)"
HARMLESS_PATHS = r"(?i)(test|example|sample|fixture|docs?/|readme|vendor|\.lock$|\.md$|\.svg$)"
#: Words whose letters count as covered by a dictionary.
DICTIONARY = (
    "about access account address after all and app are array auth back base before begin bit block body build but button byte call case change char "
    "check class client close code color column common config content control count create data date day default delete demo dev document domain "
    "end error event example false file filter find first flag font for form from function get group handler has have head hello home host http https "
    "image index info input insert int item json key last left length level line link list load local log login main map max message method min model "
    "module name new next node not null number object option order output page param password path point port post print private prod public query "
    "read record request reset response result right row sample save script search secret select server service session set show size some sort source "
    "start state static status step string style sub system table target task temp test text that the this time title token top total true type "
    "update url user value version view web while will window with word work world write xml year you your"
).split()
LABELLED = 6000
FEATURES = (
    "length", "digits", "uppers", "lowers", "marks", "distinct", "transitions", "longest_letters", "covered", "hex", "decimal", "uuid", "prefix",
    "assigned", "quoted", "url", "block", "others", "spaces", "placeholder", "secret_words", "harmless_words", "harmless_path",
)


def count_of(pattern: str, column: str = "candidate") -> Column:
    return F.regexp_count(F.col(column), F.lit(pattern)).cast("double")


def share_of(pattern: str) -> Column:
    return count_of(pattern) / F.length("candidate")


def with_features(rows: DataFrame) -> DataFrame:
    """Adds FEATURES to rows (candidate, before, after, path)."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    # Longer words first, so that a word inside another does not hide it.
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    rest = F.regexp_replace(F.lower("candidate"), F.lit(words), F.lit(""))
    changes = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"
    values = {
        "length": F.length("candidate").cast("double"),
        "digits": share_of("[0-9]"),
        "uppers": share_of("[A-Z]"),
        "lowers": share_of("[a-z]"),
        "marks": share_of("[+/_=-]"),
        "distinct": F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate"),
        "transitions": share_of(changes),
        "longest_letters": F.coalesce(F.array_max(F.transform(F.regexp_extract_all("candidate", F.lit("([A-Za-z]+)")), F.length)), F.lit(0)) / F.length("candidate"),
        "covered": (F.length("candidate") - F.length(rest)) / F.length("candidate"),
        "hex": flag(F.col("candidate").rlike("^[0-9a-fA-F]+$")),
        "decimal": flag(F.col("candidate").rlike("^[0-9]+$")),
        "uuid": flag(F.col("candidate").rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "prefix": flag(F.col("candidate").rlike(PREFIXES)),
        "assigned": flag(F.col("before").rlike(r"(=|:)\s*[\"'`]?$")),
        "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "url": flag(F.col("before").rlike(r"://[^\s/@]*:$") & F.col("after").rlike("^@")),
        "block": flag(F.col("candidate").rlike("^-----BEGIN ")),
        "others": share_of(r"[^A-Za-z0-9+/_=\s-]"),
        "spaces": share_of(r"\s"),
        "placeholder": flag(F.col("candidate").rlike(PLACEHOLDERS)),
        "secret_words": flag(F.col("before").rlike(SECRET_WORDS)),
        "harmless_words": flag(F.col("before").rlike(HARMLESS_WORDS)),
        "harmless_path": flag(F.col("path").rlike(HARMLESS_PATHS)),
    }
    return rows.withColumns({k: F.coalesce(v, F.lit(0.0)).cast("double") for k, v in values.items()})


def find_candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """Rows (row, id, path, candidate, start, before, after), one for each place of a candidate; start counts characters from 0."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), path.alias("path"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).filter(F.col("text").rlike(CANDIDATE))
    # The matches and what stands between them give the offsets, as both walk the same matches.
    found = rows.withColumn("all", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).withColumn("gaps", F.split("text", CANDIDATE, -1))
    sizes = F.zip_with(F.slice("gaps", 1, F.size("all")), "all", lambda g, x: F.struct(F.length(g).alias("gap"), F.length(x).alias("own")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["own"]).alias("at"), F.array_append(acc["starts"], acc["at"] + x["gap"]).alias("starts"))
    found = found.withColumn("starts", F.aggregate(sizes, begin, step)["starts"])
    each = found.select("row", "id", "path", "text", F.inline(F.arrays_zip(F.col("all").alias("candidate"), F.col("starts").alias("start"))))
    first = F.greatest(F.lit(0), F.col("start") - BEFORE)
    return each.select(
        "row", "id", "path", "candidate", F.col("start").cast("bigint").alias("start"),
        F.substring("text", first + 1, F.col("start") - first).alias("before"),
        F.substring("text", F.col("start") + F.length("candidate") + 1, F.lit(AFTER)).alias("after"),
    )


def labelled_findings(spark: SparkSession, count: int = LABELLED) -> DataFrame:
    """Rows (candidate, before, after, path, label) made by rule from digests of their numbers: half secrets, half not."""
    rows = spark.range(count, numPartitions=4)
    hexes = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 256)
    coded = F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("coded"), F.col("id").cast("string")), 512))), "\n=", "")
    pick = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    one_of = lambda salt, *values: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), pick(salt, len(values)) + 1)
    plain = F.translate(coded, "+/", "aZ")
    word = lambda salt: F.element_at(F.array(*map(F.lit, DICTIONARY)), pick(salt, len(DICTIONARY)) + 1)
    small = F.lpad(pick("n", 1000).cast("string"), 2, "0")
    secret = one_of(
        "kind", F.substring(hexes, 1, 40), F.substring(hexes, 1, 32), hexes, F.concat(F.lit("AKIA"), F.upper(F.substring(hexes, 1, 16))),
        F.concat(F.lit("ghp_"), F.substring(plain, 1, 36)), F.concat(F.lit("sk_live_"), F.substring(plain, 1, 24)), F.concat(F.lit("eyJ"), F.substring(plain, 1, 60)),
        F.substring(coded, 1, 40), F.substring(plain, 1, 20), F.concat(F.lit("xoxb-"), F.substring(F.conv(F.substring(hexes, 1, 12), 16, 10), 1, 12), F.lit("-"), F.substring(plain, 1, 24)),
    )
    harmless = one_of(
        "kind", F.substring(hexes, 1, 40), F.substring(hexes, 1, 32), hexes,
        F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)),
        F.substring(F.concat(F.conv(F.substring(hexes, 1, 14), 16, 10), F.conv(F.substring(hexes, 15, 14), 16, 10)), 1, 16),
        F.concat_ws("_", word("a"), word("b"), word("c"), small), F.concat(word("a"), F.lit("-"), word("b"), F.lit("-"), small, F.lit("-"), word("c")),
        F.concat(F.lit("/"), word("a"), F.lit("/"), word("b"), F.lit("/v2/"), word("c")), F.concat(F.lit("your_"), word("a"), F.lit("_key_1234")), F.lit("xxxxxxxxxxxx1234"),
        F.concat(F.initcap(word("a")), F.initcap(word("b")), F.initcap(word("c")), small), F.concat(F.lit("2024-01-02T"), F.lpad(small, 4, "0"), F.lit("00")),
    )
    secret_before = one_of("ctx", 'token = "', 'api_key="', "password: ", "secret_key = '", 'auth_token: "', "Authorization: Bearer ", 'export ACCESS_KEY="', "client_secret=", " ")
    plain_before = one_of("ctx", "commit ", "sha256:", "checksum = ", 'id: "', "see ", "order ", " ", "the file ", 'version = "', "md5 ", 'class="', "url: ")
    mark = one_of("mark", "!", "@", "#", "$", "&", "%", "?")
    # Forms that only their place or their frame tells.
    letters = F.translate(plain, "0123456789", "kQzXvRtYbN")
    phrase = F.concat_ws(" ", F.substring(letters, 1, 5), F.lower(F.substring(letters, 6, 6)), F.lower(F.substring(letters, 12, 5)))
    password = one_of(
        "password", F.concat(word("a"), small, mark, F.substring(plain, 1, 2)), F.concat(F.initcap(word("a")), mark, F.substring(plain, 1, 3), small, mark),
        F.concat(F.substring(plain, 1, 7), mark, small, F.lit("-"), word("b")), F.substring(letters, 1, 20), F.substring(plain, 1, 10), phrase,
    )
    block = F.concat(F.lit("-----BEGIN "), one_of("block", "RSA ", "EC ", "OPENSSH ", ""), F.lit("PRIVATE KEY-----"))
    block = F.when(pick("body", 2) == 0, block).otherwise(F.concat(block, F.lit("\n"), coded, F.lit("\n"), F.replace(block, F.lit("BEGIN"), F.lit("END"))))
    jwt = F.concat(F.lit("eyJ"), F.substring(plain, 1, 17), F.lit(".eyJ"), F.substring(plain, 20, 30), F.lit("."), F.substring(letters, 1, 43))
    filler = F.concat(F.repeat(one_of("filler", "x", "X", "*", "0", "#", "a"), pick("width", 12) + 6), one_of("tail", "", "1", "1234", "99"))
    modest = one_of(
        "modest", word("a"), F.concat_ws(" ", word("a"), word("b"), word("c")), F.concat(F.lit("your "), word("a")), F.concat(F.lit("<"), word("a"), F.lit(">")),
        F.concat(F.lit("${"), F.upper(word("a")), F.lit("}")), filler, F.lit("changeme"), F.lit("required"), F.concat(word("a"), F.lit("."), word("b"), F.lit("()")),
        F.concat(word("a"), F.lit("["), word("b"), F.lit("]")), F.concat(word("a"), F.lit("_"), word("b")),
    )
    joined = one_of("joined", F.concat(word("a"), F.initcap(word("b")), F.initcap(word("c")), F.initcap(word("d"))), F.concat(word("a"), word("b"), word("c"), word("d"), word("e")), filler)
    named = one_of("named", 'password = "', "password: ", 'secret: "', "passphrase = '", 'api_key = "', "pwd=", "DB_PASSWORD=", "the password is '", 'auth_token: "')
    url = F.concat(one_of("url", "postgres", "https", "mysql", "amqp"), F.lit("://"), word("u"), F.lit(":"))
    form, context = pick("form", 10), F.col("id") % 4 > 1
    secret = F.when(context, F.when(form == 0, block).when(form == 1, jwt).otherwise(password)).otherwise(secret)
    harmless = F.when(context, F.when(form < 3, joined).otherwise(modest)).otherwise(harmless)
    secret_before = F.when(context, F.when(form == 0, F.lit("\n")).when(form == 1, F.lit("Bearer ")).when(form < 4, url).otherwise(named)).otherwise(secret_before)
    plain_before = F.when(context, F.when(form < 3, F.lit("the ")).otherwise(named)).otherwise(plain_before)
    labelled = rows.withColumn("label", (F.col("id") % 2).cast("double")).withColumn("is", F.col("label") == 1)
    # A digest alone says nothing: only words like token make it a secret; credentials with a prefix are told without.
    before = F.when(F.col("is") & ~context & (pick("kind", 10).isin(0, 1, 2, 7, 8)) & (secret_before == " "), F.lit('token = "')).when(F.col("is"), secret_before)
    labelled = labelled.select(
        "label", F.when(F.col("is"), secret).otherwise(harmless).alias("candidate"), F.concat(F.lit("some text "), before).alias("b1"),
        F.concat(F.lit("some text "), plain_before).alias("b2"), one_of("path", "src/main.py", "config/settings.yml", "app.js", "tests/test_api.py", "docs/readme.md", "src4").alias("path"),
    )
    labelled = labelled.withColumn("before", F.coalesce("b1", "b2")).drop("b1", "b2")
    return labelled.withColumn("after", F.when(F.col("before").rlike("\"$"), '" and').when(F.col("before").rlike("'$"), "' and").when(F.col("before").rlike("://[^ ]*:$"), "@host/db and").otherwise(" and"))


def train_forest(findings: DataFrame, trees: int = 30, depth: int = 7) -> PipelineModel:
    """A forest over FEATURES, from labelled findings (candidate, before, after, path, label)."""
    stages = [
        VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
        RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=20, featuresCol="features", labelCol="label"),
    ]
    return Pipeline(stages=stages).fit(with_features(findings))


def scan(
    docs: DataFrame,
    model: PipelineModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str | None = "source",
    threshold: float = 0.5,
) -> DataFrame:
    """One row per text and candidate: id, start, starts (of all places), length, places, masked, sha256, score, is_secret."""
    scored = model.transform(with_features(find_candidates(docs, id_col, text_col, path_col)))
    places = scored.withColumn("score", F.round(vector_to_array("probability")[1], 6)).groupBy("row", "id", "candidate")
    each = places.agg(F.sort_array(F.collect_list("start")).alias("starts"), F.max("score").alias("score"))
    shown = F.least(F.lit(4), F.floor(F.length("candidate") / 4).cast("int"))
    masked = F.concat(F.substring("candidate", F.lit(1), shown), F.lit("…"), F.length("candidate").cast("string"))
    return each.select(
        F.col("id").alias(id_col), F.col("starts")[0].alias("start"), "starts", F.length("candidate").cast("bigint").alias("length"),
        F.size("starts").cast("bigint").alias("places"), masked.alias("masked"),
        F.sha2(F.col("candidate").cast("binary"), 256).alias("sha256"), "score", (F.col("score") >= threshold).alias("is_secret"),
    )
