"""Secret scans: candidates by pattern, false positives removed by a random
forest on candidate length, character transitions, dictionary coverage, path
and neighbouring words, trained from labelled findings.

Candidates are runs of key-like characters that hold a digit, and values
assigned to a key-like name.  Patterns alone flag card numbers, counters and
identifiers too; the forest decides which of them are secrets.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import bounded_batches, free_name, to_scratch, unit_hash

KEY_NAMES = "key|token|secret|passw|pwd|auth|credential|bearer|private"
_ASSIGNED = re.compile(rf"(?i)\w{{0,32}}(?:{KEY_NAMES})\w{{0,32}}[\"']?\s{{0,4}}[:=]\s{{0,4}}[\"']?"
                       r"([^\s\"']{8,})")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}")
_KEYED = re.compile(rf"(?i)(?:{KEY_NAMES})")
_SAMPLE = re.compile(r"(?i)example|sample|dummy|placeholder|your[_-]|xxxx|test|fake|changeme")
_TEST_PATH = re.compile(r"(?i)(?:^|[/._-])(?:tests?|examples?|docs?|mocks?|fixtures?|samples?)(?:[/._-]|$)")
_CONFIG_PATH = re.compile(r"(?i)\.(?:env|ya?ml|json|ini|toml|cfg|conf|properties|pem|key)$")
_WORD = re.compile(r"[^\W\d_]{3,}")


def may_hold(text: str) -> Column:
    """True for every text with a candidate: a digit, or a key-like name."""
    c = F.col(text).cast("string")
    low = F.lower(c)
    out = c.rlike("[0-9]")
    for name in KEY_NAMES.split("|"):
        out = out | F.contains(low, F.lit(name))
    return F.coalesce(out, F.lit(False))


FEATURES = ["length", "entropy", "digits", "upper", "hex", "kinds_change", "transition_score",
            "dictionary_cover", "assigned", "quoted", "key_name_near", "sample_words_near",
            "near_words_known", "test_path", "config_path", "path_depth"]


def _kind(c: str) -> str:
    return "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "-"


class Lexicon:
    """Known words with their counts, and letter transitions."""

    def __init__(self, words: dict[str, int]):
        self.words = frozenset(words)
        pairs, singles = Counter(), Counter()
        for w, n in words.items():
            for a, b in zip(w, w[1:]):
                pairs[a + b] += n
                singles[a] += n
        self.pairs = {k: math.log2((v + 0.5) / (singles[k[0]] + 20)) for k, v in pairs.items()}

    def transition_score(self, s: str) -> float:
        """Mean log2 probability of the letter pairs; others count as rare."""
        s = s.lower()
        if len(s) < 2:
            return 0.0
        return sum(self.pairs.get(a + b, -10.0) for a, b in zip(s, s[1:])) / (len(s) - 1)

    def cover(self, s: str) -> float:
        """Share of the characters that known words cover, longest first from
        the left."""
        s, at, got = s.lower(), 0, 0
        while at < len(s):
            n = next((n for n in range(min(12, len(s) - at), 3, -1) if s[at:at + n] in self.words), 0)
            got += n
            at += n or 1
        return got / max(1, len(s))


def learn_lexicon(docs: DataFrame, text: str = "text", words: int = 5000) -> Lexicon:
    """The ``words`` most frequent words of all texts, with their counts."""
    rows = docs.select(
        F.explode(F.regexp_extract_all(F.lower(F.col(text).cast("string")),
                                       F.lit(r"(?U)\b\p{L}{4,12}\b"), F.lit(0))).alias("w"))
    top = rows.groupBy("w").count().orderBy(F.desc("count"), "w").limit(words).collect()
    return Lexicon({r["w"]: r["count"] for r in top})


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, assigned) of the candidates of a text, none overlapping;
    an assigned value wins over a plain run."""
    out = [(m.start(1), m.end(1), True) for m in _ASSIGNED.finditer(text)]
    taken = [(a, b) for a, b, _ in out]
    at = 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at < len(taken) and taken[at][0] < b:
            continue
        if any(c.isdigit() for c in m.group()):
            out.append((a, b, False))
    return sorted(out)


def describe(text: str, start: int, end: int, assigned: bool, path: str, lex: Lexicon) -> list[float]:
    """The features of one candidate, in the order of FEATURES."""
    s = text[start:end]
    n = len(s)
    counts = Counter(s)
    near = text[max(0, start - 64):start] + " " + text[end:end + 64]
    words = _WORD.findall(near.lower())
    return [float(n), -sum(c / n * math.log2(c / n) for c in counts.values()),
            sum(map(str.isdigit, s)) / n, sum(map(str.isupper, s)) / n,
            sum(c in "0123456789abcdefABCDEF" for c in s) / n,
            sum(_kind(a) != _kind(b) for a, b in zip(s, s[1:])) / max(1, n - 1),
            lex.transition_score(s), lex.cover(s), float(assigned),
            float(text[start - 1:start] in ("'", '"')),
            float(bool(_KEYED.search(text[max(0, start - 40):start]))),
            float(bool(_SAMPLE.search(near) or _SAMPLE.search(s))),
            sum(w in lex.words for w in words) / max(1, len(words)),
            float(bool(_TEST_PATH.search(path))), float(bool(_CONFIG_PATH.search(path))),
            float(path.count("/"))]


def scan(docs: DataFrame, lex: Lexicon, key: str = "doc_id", text: str = "text",
         path: str = "source") -> DataFrame:
    """One row per candidate of the whole texts: key, row_hash (of text and
    path), start and length (code points), value, assigned, features."""
    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(k, h, a, b - a, t[a:b], on, describe(t, a, b, on, w or "", lex))
                    for k, h, t, w in zip(p["key"], p["row_hash"], p["text"], p["path"])
                    for a, b, on in candidates(t or "")]
            yield pd.DataFrame(rows, columns=["key", "row_hash", "start", "length", "value",
                                              "assigned", "features"])
    rows = bounded_batches(docs).where(may_hold(text)).select(
        F.col(key).alias("key"), F.xxhash64(text, path).alias("row_hash"),
        F.col(text).cast("string").alias("text"), F.col(path).cast("string").alias("path"))
    return rows.mapInPandas(find, f"key {dict(docs.dtypes)[key]}, row_hash long, start long, "
                            "length long, value string, assigned boolean, features array<double>")


def train(labelled: DataFrame, bound: int = 8000, trees: int = 30, depth: int = 6,
          seed: int = 7) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (features, label 0 or 1); None if there
    are none.  Of more than ``bound`` rows a hashed sample of that many, drawn
    per label: a label with under its share of ``bound`` keeps all its rows."""
    labelled = labelled.where("features IS NOT NULL").withColumn(
        "label", F.col("label").cast("double")).where("label IN (0, 1)")
    counts = sorted((r["count"], r["label"]) for r in labelled.groupBy("label").count().collect())
    if not counts:
        return None
    part = None
    for i, (n, label) in enumerate(counts):
        share = bound // (len(counts) - i)
        own = labelled.where(F.col("label") == label)
        if n > share:
            own = own.orderBy(unit_hash("features", seed=seed), "features").limit(share)
        bound -= min(n, share)
        part = own if part is None else part.unionByName(own)
    rows = to_scratch(part.select(array_to_vector("features").alias("features"), "label"), "findings")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def judge(found: DataFrame, forest: RandomForestClassificationModel | None,
          threshold: float = 0.5) -> DataFrame:
    """``found`` with score and is_secret; without a forest nothing is removed
    (score 1)."""
    if forest is None:
        return found.withColumn("score", F.lit(1.0)).withColumn("is_secret", F.lit(True))
    chance = vector_to_array("probability")
    score = (F.get(chance, F.lit(1)) if forest.numClasses > 1 else F.lit(0.0))
    out = forest.transform(found.withColumn("_v", array_to_vector("features"))
                           .withColumnRenamed("features", "_f").withColumnRenamed("_v", "features"))
    return (out.withColumn("score", score).withColumn("is_secret", F.col("score") >= threshold)
            .drop("features", "rawPrediction", "probability", "prediction")
            .withColumnRenamed("_f", "features"))


def _made_findings(lex: Lexicon, each: int, seed: int) -> list[tuple[str, str, str, list[tuple[int, int]]]]:
    """(kind, text, path, spans of the secrets) of made-up lines of code,
    settings and prose, ``each`` of a kind; no span means no secret."""
    rng = random.Random(seed)
    known = sorted(lex.words) or "the and with that this from have which would there about into over".split()
    hexes, lower, upper = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    mixed = lower + upper + "0123456789"

    def of(chars: str, n: int, m: int | None = None) -> str:
        return "".join(rng.choice(chars) for _ in range(rng.randint(n, m or n)))

    def words(n: int, sep: str = " ") -> str:
        return sep.join(rng.choice(known) for _ in range(n))

    def name() -> str:
        return rng.choice(["password", "db_password", "PASSWD", "api_key", "API_KEY", "token", "auth_token",
                           "access-token", "client_secret", "SECRET_KEY", "pwd", "credential", "private_key"])

    def jwt() -> str:
        return ".".join("eyJ" * (i < 2) + of(mixed + "-_", n, m) for i, (n, m) in enumerate(
            [(17, 40), (40, 300), (43, 86)]))

    def pem() -> str:
        kind = rng.choice(["RSA ", "EC ", "OPENSSH ", ""])
        return "\n".join([f"-----BEGIN {kind}PRIVATE KEY-----",
                          *(of(mixed + "+/", 64) for _ in range(rng.randint(2, 5))),
                          of(mixed + "+/", 20, 60) + rng.choice(["", "=", "=="]), f"-----END {kind}PRIVATE KEY-----"])

    def provider() -> str:
        return rng.choice([
            lambda: rng.choice(["AKIA", "ASIA"]) + of(upper + "234567", 16),
            lambda: rng.choice(["ghp_", "gho_", "ghs_"]) + of(mixed, 36),
            lambda: rng.choice(["sk_live_", "rk_live_", "sk-"]) + of(mixed, 24, 48),
            lambda: f"xoxb-{of(hexes[:10], 11)}-{of(hexes[:10], 12)}-{of(mixed, 24)}",
            lambda: "AIza" + of(mixed + "-_", 35), lambda: "glpat-" + of(mixed + "-_", 20),
            lambda: of(mixed, 40), lambda: of(mixed + "+/", 43) + "="])()

    def uuid() -> str:
        return "-".join(of(hexes, n) for n in (8, 4, 4, 4, 12))

    def sample() -> str:
        return rng.choice([
            lambda: rng.choice(["example", "sample", "dummy", "changeme", "test", "fake"]) + of(hexes[:10], 3, 8),
            lambda: rng.choice(["your-", "your_", "my_example_"]) + rng.choice(["api-key-here", "token_here", "password1"]),
            lambda: of("x", 8, 40), lambda: "<" + words(1) + "-placeholder>", lambda: of("*", 8, 16)])()

    def reference() -> str:
        w = rng.choice(known)
        return rng.choice(["${%s_VALUE}" % w.upper(), "os.environ[%s]" % w, "get_%s(self)" % w, "settings.%s_value" % w,
                           "{{ vault.%s }}" % w, "%s_id_%s" % (w, of(hexes[:10], 1, 3))])
    assigned = {
        "assigned hex": (True, lambda: of(hexes, rng.choice([32, 40, 64]))),
        "assigned mixed": (True, lambda: rng.choice([of(mixed, 10, 60), of(mixed + "!#$%&*+-/=?@^_", 10, 40), jwt()])),
        "assigned long": (True, lambda: of(mixed + "+/", 513, 3000)),
        "assigned small letters": (True, lambda: of(lower, 8, 24)),
        "assigned letters": (True, lambda: rng.choice([
            of(lower + upper, 8, 40), rng.choice(known).title() + of(lower, 6, 12)])),
        "assigned pass phrase": (True, lambda: words(rng.randint(3, 5), rng.choice(["", "-", "_"]))),
        "placeholder": (False, sample), "reference": (False, reference),
        "assigned number": (False, lambda: of(hexes[:10], 8, 19)),
        "assigned word": (False, lambda: max(rng.sample(known, min(8, len(known))), key=len) + rng.choice(["", ",", "."]))}
    plain = {
        "provider key": (True, provider), "JWT": (True, jwt), "PEM": (True, pem),
        "card or counter": (False, lambda: of(hexes[:10], 12, 19)),
        "date, phone or order": (False, lambda: rng.choice([
            f"20{of(hexes[:10], 2)}-0{of('123456789', 1)}-1{of(hexes[:10], 1)}T1{of(hexes[:10], 1)}",
            f"{of(hexes[:10], 3)}-{of(hexes[:10], 3)}-{of(hexes[:10], 4)}",
            f"{of(upper, 2, 4)}-{of(hexes[:10], 4)}-{of(hexes[:10], 6)}"])),
        "uuid": (False, uuid),
        "path or name": (False, lambda: rng.choice(["/", "_", "-"]).join([*rng.sample(known, 2), rng.choice(
            ["v", "part", "run"]) + of(hexes[:10], 1, 4), rng.choice(known)])),
        "digest": (False, lambda: rng.choice(["commit ", "sha256:", "md5 ", "revision "]) + of(hexes, rng.choice([32, 40, 64])))}
    paths = ["", "", "src3", "config/app.env", "deploy/prod.yaml", "tests/test_login.py", "docs/guide.md", "a/b/c/main.py"]
    out = []
    for kind, (secret, make) in {**assigned, **plain}.items():
        for _ in range(each):
            before, value = words(rng.randint(0, 12)), make()
            if kind == "assigned word":
                before += f" {name()}: "
            elif kind in assigned:
                quote = rng.choice(["", "'", '"'])
                before += f" {name()}{rng.choice(['=', ' = ', ': ', ':'])}{quote}"
            else:
                quote = rng.choice(["", "", "'", '"'])
                before += rng.choice([" ", "\n", ": ", " uses ", " key ", " Authorization: Bearer "] if secret
                                     else [" ", "\n", ": ", " uses ", " key ", " no. "]) + quote
            text = f"{before}{value}{quote if kind != 'assigned word' else ''} {words(rng.randint(0, 12))}"
            span = [(len(before), len(before) + len(value))] if secret else []
            out.append((kind, text, rng.choice(paths), span))
    return out


def reviewed_findings(found: DataFrame, lex: Lexicon | None = None, each: int = 250, seed: int = 29) -> DataFrame:
    """Stand-in for a reviewer's list, as the tables have none: findings in
    made-up lines, labelled by what was put there and not by their features.
    Secrets are assigned values (mixed, letters only, pass phrases, over 512
    characters), bare provider keys, JWTs and PEM lines; the others are
    placeholders, references, numbers, words, dates, uuids, paths and digests.
    ``lex``: the lexicon that ``found`` is described with, whose words make
    the prose; ``found`` itself is not read."""
    lex = lex or Lexicon({})
    rows = [(describe(text, a, b, on, path, lex), int(any(a < e and s < b for s, e in spans)))
            for _, text, path, spans in _made_findings(lex, each, seed) for a, b, on in candidates(text)]
    return found.sparkSession.createDataFrame(rows, "features array<double>, label int")


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, key: str = "doc_id",
                 text: str = "text", path: str = "source") -> DataFrame:
    """One row per candidate: key, row_hash, start, length, value, assigned,
    features, score, is_secret.

    ``labelled``: findings with features and label; without it the stand-in
    list of reviewed_findings.  Null and blank texts have no candidate, null
    paths count as empty, repeated rows return their candidates again, extra
    columns are ignored, and an empty table gives no rows.
    """
    lex = learn_lexicon(docs, text)
    found = to_scratch(scan(docs, lex, key, text, path), "candidates")
    forest = train(reviewed_findings(found, lex) if labelled is None else labelled)
    return judge(found, forest)


def redact_secrets(docs: DataFrame, labelled: DataFrame | None = None, key: str = "doc_id",
                   text: str = "text", path: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding that the forest holds for a secret replaced
    by ``mark``; all rows and columns stay.  Only texts that may hold a
    candidate are joined with findings; the others pass as they are."""
    h, s = free_name(docs, "_hash"), free_name(docs, "_spans")
    found = scan_secrets(docs, labelled, key, text, path).where("is_secret")
    spans = found.groupBy("row_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias(s)).withColumnRenamed("row_hash", h)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, where in zip(texts, spans):
            if where is not None and t is not None:
                for w in reversed(list(where)):
                    t = t[:w["start"]] + mark + t[w["start"] + w["length"]:]
            out.append(t)
        return pd.Series(out, dtype=object)
    may = may_hold(text)
    some = docs.where(may).withColumn(h, F.xxhash64(text, path)).join(spans, h, "left")
    some = some.withColumn(text, F.when(F.col(s).isNull(), F.col(text)).otherwise(
        cut(F.col(text).cast("string"), F.col(s))))
    return some.select(*docs.columns).unionByName(docs.where(~may))
