"""Secret scans with a random forest that removes false positives, in SQL expressions only.

Candidates are long runs of key characters with a digit, well-known key forms, and whatever follows a secret word and = or :
or is the password of a login in an address. Each occurrence gets features - length, character
transitions, dictionary coverage, path, neighbouring words - and the share of trees that call it a secret. The
forest is grown on the driver from labelled findings; its trees become CASE expressions, so scanning is one
narrow projection: nothing is shuffled and no Python runs on the executors.
"""

from __future__ import annotations

import random
import string
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a candidate looks like, and words that matter in and around it.
_RUN = r"(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
_FORMS = r"(?:AKIA|ASIA)[A-Z]{16}(?![A-Za-z0-9])|(?:ghp_|gho_|github_pat_|sk_live_|rk_live_|xox[abps]-|AIza|glpat-|npm_)[A-Za-z0-9_-]{16,}+"
_NAMES = r"(?:secret|token|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|bearer)"
#: A secret word with = or :, or a login in an address, and its value: a whole run, what quotes hold, or anything up to a space.
_NAMED = rf"[A-Za-z0-9+/_-]{{0,40}}?(?i:{_NAMES})[A-Za-z0-9_-]{{0,16}}[\"']?[ \t]{{0,2}}[:=]{{1,2}}>?[ \t]{{0,2}}(?:(?i:bearer|basic)[ \t]{{1,2}})?[\"']?"
_LOGIN = r"[A-Za-z][A-Za-z0-9+-]{1,20}://[^\s/:@\"']{1,64}:"
_VALUE = rf"(?:(?:{_RUN}|{_FORMS})(?=[\s\"'.,;)\]}}<]|&[A-Za-z_]+=|\z)|(?<=\")[^\s\"]{{6,}}+(?=\")|(?<=')[^\s']{{6,}}+(?=')|[^\s\"'][^\s\"]{{4,}}[^\s\"'.,;:)\]}}])"
CONTEXT = rf"(?:{_LOGIN}|{_NAMED})(?=\S{{6,}}\z)"
_PEM = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]*?-----END [A-Z ]{0,30}PRIVATE KEY-----"
CANDIDATE = rf"{_PEM}|(?<![A-Za-z0-9+/_-])(?:{_LOGIN}[^\s@\"]{{6,256}}(?=@)|{_NAMED}{_VALUE}|{_RUN}|{_FORMS})"
KNOWN_FORMS = r"^(?:-----BEGIN|AKIA|ASIA|ghp_|gho_|github_pat_|sk_live_|rk_live_|xox[abps]-|AIza|glpat-|npm_)"
SECRET_WORDS = r"(?i)(?:secret|token|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|bearer)[A-Za-z0-9_-]{0,16}\W{0,6}$"
OTHER_WORDS = r"(?i)(?:sha-?\d*|md5|commit|checksum|digest|uuid|guid|revision|etag|integrity|version|sample|example|dummy|placeholder|order|card|account|isbn|phone|build|ref|trace|image|id)\W{0,6}$"
DICTIONARY = [
    "access", "account", "admin", "after", "alpha", "apache", "before", "beta", "bucket", "build", "change", "client", "cloud", "config", "content", "data", "default", "demo",
    "docs", "dummy", "example", "file", "github", "google", "html", "image", "index", "insert", "item", "key", "license", "linux", "local", "main", "model", "name", "network", "number",
    "object", "order", "page", "password", "path", "placeholder", "production", "project", "public", "python", "release", "sample", "secret", "server", "service", "session", "source", "spark",
    "static", "string", "table", "template", "test", "text", "the", "token", "update", "user", "value", "version", "week", "windows", "with", "world", "your",
]
TEST_PATHS = r"(?i)(?:^|[/_.-])(?:test|tests|example|examples|fixture|fixtures|docs|sample|samples)(?:[/_.-]|$)"
FEATURES = ["f_len", "f_trans", "f_digit", "f_upper", "f_hex", "f_distinct", "f_dict", "f_slashes", "f_path", "f_secret_word", "f_other_word", "f_assigned", "f_quoted", "f_known", "f_login", "f_code", "f_symbols"]
CODE = r"^[$<{%\[]|[a-z_]\(|\[[\"'a-z]|^(?:self|this|os|env|process|config|settings)[.]|^(.)\1+$|[a-z][.][a-z]"
TREES, DEPTH, LEAST_LEAF = 21, 6, 4


def _feature_sql(v: str, before: str, after: str, path: str) -> dict[str, str]:
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    n = f"greatest(length({v}), 1)"
    number = lambda b: f"cast(coalesce({b}, false) as int)"
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    return {
        "f_len": f"length({v})",
        "f_trans": f"regexp_count({v}, {q('[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])')}) / {n}",
        "f_digit": f"regexp_count({v}, '[0-9]') / {n}",
        "f_upper": f"regexp_count({v}, '[A-Z]') / {n}",
        "f_hex": number(f"{v} rlike '^[0-9a-f]+$'"),
        "f_distinct": f"size(array_distinct(split({v}, ''))) / least({n}, 64)",
        "f_dict": f"1 - length(regexp_replace(lower({v}), {q(words)}, '')) / {n}",
        "f_slashes": f"regexp_count({v}, '[/]') / {n}",
        "f_path": number(f"{before} rlike {q('[/.\\\\\\\\]$|://[^ ]*$')} or {path} rlike {q(TEST_PATHS)}"),
        "f_secret_word": number(f"{before} rlike {q(SECRET_WORDS)}"),
        "f_other_word": number(f"{before} rlike {q(OTHER_WORDS)}"),
        "f_assigned": number(f"{before} rlike {q('[=:] {0,2}[\"' + chr(39) + ']?$')}"),
        "f_quoted": number(f"{before} rlike {q('[\"' + chr(39) + ']$')} and {after} rlike {q('^[\"' + chr(39) + ']')}"),
        "f_known": number(f"{v} rlike {q(KNOWN_FORMS)}"),
        "f_login": number(f"{before} rlike {q('://[^ ]*:$')} and {after} rlike '^@'"),
        "f_code": number(f"{v} rlike {q(CODE)}"),
        "f_symbols": f"regexp_count({v}, '[^A-Za-z0-9]') / {n}",
    }


def labelled_findings(n: int = 1600, seed: int = 20) -> list[tuple[str, str, str, str, int]]:
    """A deterministic set of labelled findings (value, text before, text after, path, label), drawn from forms of real and false secrets."""
    r = random.Random(seed)
    hexa, mixed, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + "234567"
    some = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    word = lambda: some("abcdefghilmnoprstu", r.randint(2, 9))
    prose = lambda: f"{word()} {word()} "
    names = ["token", "password", "secret", "api_key", "apikey", "access_key", "auth_token", "client_secret", "passwd", "private_key"]
    assign = [' = "', "=", ": ", ' = ', '="', ": '", " : "]

    def secret() -> tuple[str, str, str]:
        kind = r.randrange(9)
        if kind == 6:  # short passwords, with symbols or without
            how, value = r.choice([*assign, "=", ":"]), some(mixed + r.choice(["", "!&@#$%^*?"]), r.randint(6, 15)) + r.choice(string.digits)
            return value, prose() + r.choice(names) + how, ('"' if '"' in how else "'" if "'" in how else "") + " " + word()
        if kind == 7:  # letters only, or words with digits and symbols
            how = r.choice(assign)
            value = some(string.ascii_letters, r.choice([16, 20, 32])) if r.random() < 0.5 else word().title() + str(r.randint(10, 9999)) + r.choice("!&@#") + word()
            return value, prose() + r.choice(names) + how, ('"' if '"' in how else "'" if "'" in how else "") + " " + word()
        if kind == 8:
            return some(mixed + "!&#$%", r.randint(6, 16)) + "3k", prose() + r.choice(["postgres", "mysql", "amqp", "https"]) + "://" + word() + ":", "@" + word() + ".example.com/" + word()
        if kind == 0:
            return r.choice(["AKIA", "ASIA"]) + some(upper, 16), prose(), " " + word()
        if kind == 1:
            return r.choice(["ghp_", "sk_live_", "glpat-", "xoxb-"]) + some(mixed, r.choice([20, 24, 36])) + "7", prose(), " " + word()
        how = r.choice(assign)
        value = some(hexa, r.choice([16, 18, 20, 32, 40, 64])) if kind < 5 else some(mixed, r.choice([20, 32, 40])) + "4"
        return value + ("1" if value.isalpha() else ""), prose() + r.choice(names) + how, ('"' if '"' in how else "'" if "'" in how else "") + " " + word()

    def block() -> tuple[str, str, str]:
        kind, body = r.choice(["", "RSA ", "EC ", "OPENSSH "]), "\n".join(some(mixed + "+/", 64) for _ in range(r.randint(2, 12)))
        return f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----", prose(), "\n" + word()

    def other(kind: int | None = None) -> tuple[str, str, str]:
        kind = r.randrange(13) if kind is None else kind
        if kind >= 10:  # what stands after a secret word in prose and code
            how, w = r.choice([*assign, ": "]), some("abcdefghilmnoprstu", r.randint(6, 12))
            value = r.choice([w, w, w.title(), r.choice(DICTIONARY) + "_" + w, f"get_{w}()", f"self.{w}", f"os.environ[{w}]", "${" + w.upper() + "}", "<" + w + ">", "{{" + w + "}}", r.choice("*x.") * r.randint(6, 12), f"{w}-{r.choice(DICTIONARY)}", f"{w}.{word()}"])
            return value, prose() + r.choice(names) + how, ('"' if '"' in how else "'" if "'" in how else "") + " " + word()
        if kind == 0:
            return some(hexa, r.choice([32, 40, 64])), prose() + r.choice(["commit ", "sha1 ", "md5: ", "checksum ", "sha256: ", "digest=", "etag: ", "revision "]), " " + word()
        if kind == 1:
            return "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), prose() + r.choice(["", "uuid ", "id ", "id: ", "trace "]), " " + word()
        if kind == 2:
            return some(string.digits, r.randint(16, 24)), prose() + r.choice(["", "card ", "order ", "account "]), " " + word()
        if kind == 3:
            return "/".join(r.choice(DICTIONARY) for _ in range(4)) + str(r.randint(1, 99)), prose(), " " + word()
        if kind == 4:
            return "_".join(["your", *r.sample(names, 1), r.choice(["here", "example", "placeholder"]), str(r.randint(1, 999)) + "00"]), prose() + r.choice(names) + r.choice(assign), " " + word()
        if kind == 5:
            return "".join(r.choice(DICTIONARY).title() for _ in range(4)) + str(r.randint(1, 9)), prose(), "( " + word()
        if kind == 6:
            return "-".join(["2024", "01", str(r.randint(10, 28)), *(r.choice(DICTIONARY) for _ in range(3))]), prose() + "https://example.com/", " " + word()
        if kind == 7:
            return some("aeinorst", r.randint(16, 30)) + str(r.randint(1, 9)), prose(), " " + word()
        if kind == 8:
            return r.choice("ax0") * r.randint(16, 32) + "0", prose() + r.choice(names) + r.choice(assign), " " + word()
        return "v1-" + "-".join(word() for _ in range(4)), prose(), " " + word()

    out = []
    for i in range(n):
        label = i % 2
        value, before, after = secret() if label else other()
        out.append((value, before[-60:], after[:40], "src/main.py" if label or r.random() < 0.7 else "tests/fixtures/a.txt", label))
    for _ in range(n // 20):  # key blocks, and more of the code that stands after secret words
        out += [(v, b[-60:], a[:40], "src/main.py", y) for y, (v, b, a) in ((1, block()), (0, other(10)), (0, other(11)))]
    return out


def grow(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[object]:
    """Trees as nested (feature, threshold, left, right) or a share; bootstrap rows, a random third of the features at a node."""
    rng = np.random.default_rng(seed)

    def node(rows: np.ndarray, depth: int) -> object:
        share = float(y[rows].mean())
        if depth == 0 or share in (0.0, 1.0) or len(rows) < 2 * LEAST_LEAF:
            return round(share, 6)
        found = None
        for f in rng.choice(x.shape[1], size=max(1, x.shape[1] // 3), replace=False):
            values = np.unique(x[rows, f])
            cuts = (values[1:] + values[:-1]) / 2
            for c in cuts if len(cuts) <= 12 else np.quantile(cuts, np.linspace(0.04, 0.96, 12)):
                left = x[rows, f] <= c
                nl = int(left.sum())
                if min(nl, len(rows) - nl) < LEAST_LEAF:
                    continue
                a, b = y[rows][left].mean(), y[rows][~left].mean()
                impurity = nl * a * (1 - a) + (len(rows) - nl) * b * (1 - b)
                if found is None or impurity < found[0] - 1e-12:
                    found = (impurity, int(f), float(c), left)
        if found is None:
            return round(share, 6)
        _, f, c, left = found
        return f, round(c, 6), node(rows[left], depth - 1), node(rows[~left], depth - 1)

    return [node(rng.integers(0, len(y), len(y)), DEPTH) for _ in range(TREES)]


def _tree_sql(tree: object, var: str) -> str:
    if not isinstance(tree, tuple):
        return f"{tree}D"
    f, c, left, right = tree
    return f"CASE WHEN {var}.{FEATURES[f]} <= {c}D THEN {_tree_sql(left, var)} ELSE {_tree_sql(right, var)} END"


_forests: dict[int, list[object]] = {}


def train(spark: SparkSession, findings: Sequence[tuple[str, str, str, str, int]] | None = None) -> list[object]:
    """Grow the forest; the findings' features are computed by the very expressions that score."""
    key = hash(tuple(findings)) if findings is not None else 0
    if key not in _forests:
        rows = list(findings) if findings is not None else labelled_findings()
        lit = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        values = ", ".join(f"({lit(v)}, {lit(b)}, {lit(a)}, {lit(p)}, {y})" for v, b, a, p, y in rows)
        cols = ", ".join(f"cast({sql} as double) as {name}" for name, sql in _feature_sql("v", "b", "a", "p").items())
        got = spark.sql(f"SELECT {cols}, y FROM VALUES {values} AS t(v, b, a, p, y)").collect()
        _forests[key] = grow(np.array([list(r)[:-1] for r in got], float), np.array([r[-1] for r in got], float))
    return _forests[key]


#: Occurrences whose lengths are summed at a time, so that places cost far less than one pass over all before for each.
_STEP = 256


def _walk(text: str, path: str, forest: list[object]) -> str:
    """SQL of an array that is empty, or holds one struct: the pieces ``p`` of the text between the matches, and the occurrences ``o``.

    A match begins with its context (``lead``), if any, which is no part of the value. The text is cut once; places are
    sums of lengths, and an occurrence's surroundings come from the pieces and the match next to it.
    """
    lit = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    total = lambda xs: f"aggregate({xs}, 0L, (s, x) -> s + x)"
    up_to = lambda n: f"sequence(0, {n} - 1)"
    found = f"filter(array(regexp_extract_all({text}, {lit(CANDIDATE)}, 0)), m -> size(m) > 0)"
    cut = f"transform({found}, m -> struct(m as m, split({text}, {lit(CANDIDATE)}, -1) as p))"
    cut = f"transform({cut}, c -> struct(c.m as m, c.p as p, zip_with(c.m, slice(c.p, 1, size(c.m)), (x, y) -> cast(length(x) + length(y) as bigint)) as l))"
    steps = f"cast(ceil(size(c.l) / {_STEP}) as int)"
    cut = f"transform({cut}, c -> struct(c.m as m, c.p as p, c.l as l, transform({up_to(steps)}, b -> {total(f'slice(c.l, b * {_STEP} + 1, {_STEP})')}) as t))"
    cut = f"transform({cut}, c -> struct(c.m as m, c.p as p, c.l as l, transform({up_to('size(c.t)')}, b -> {total('slice(c.t, 1, b)')}) as t))"
    at = f"cast(floor(i / {_STEP}) as int)"
    start = f"get(c.t, {at}) + {total(f'slice(c.l, {at} * {_STEP} + 1, i % {_STEP})')} + length(get(c.p, i))"
    last = lambda s: f"right(coalesce({s}, ''), 60)"
    first = lambda s: f"left(coalesce({s}, ''), 40)"
    one = f"struct(x as x, regexp_replace(x, {lit('^' + CONTEXT)}, '') as v, {start} as start, concat({last('get(c.p, i - 1)')}, {last('get(c.m, i - 1)')}, {last('get(c.p, i)')}) as b, concat({first('get(c.p, i + 1)')}, {first('get(c.m, i + 1)')}) as a)"
    occ = f"transform(c.m, (x, i) -> {one})"
    occ = f"transform({occ}, o -> struct(o.v as v, left(o.x, length(o.x) - length(o.v)) as lead, o.start as start, o.b as b, left(o.a, 40) as after))"
    occ = f"transform({occ}, o -> struct(o.v as v, o.lead as lead, o.start + length(o.lead) + 1 as start, right(concat(o.b, o.lead), 60) as before, o.after as after))"
    feats = ", ".join(f"cast({sql} as double) as {name}" for name, sql in _feature_sql("o.v", "o.before", "o.after", path).items())
    occ = f"transform({occ}, o -> struct(o.v as v, o.lead as lead, o.start as start, o.before as before, o.after as after, {feats}))"
    score = "(" + " + ".join(_tree_sql(t, "f") for t in forest) + f") / {len(forest)}D"
    occ = f"transform({occ}, f -> struct(f.v as value, f.lead as lead, f.start as start, f.before as before, f.after as after, {score} as score))"
    return f"transform({cut}, c -> struct(c.p as p, {occ} as o))"


def findings_column(text: str, path: str, forest: list[object]) -> Column:
    """array<struct<value, lead, start, before, after, score>>: every candidate occurrence in a text, start from 1.

    A null text has none (an empty array). ``before`` reaches back 60 characters, at most to the end of the match before the last.
    """
    return F.expr(f"coalesce(flatten(transform({_walk(text, path, forest)}, w -> w.o)), array())")


def scan(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, start, length, value, score, is_secret), one row per candidate occurrence.

    Null and empty texts and texts without candidates give no row; repeated rows give their findings each; a
    null id stays null. Values have no greatest length. Other columns are not read.
    """
    forest = train(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"), (F.col(path_col).cast("string") if path_col else F.lit("")).alias("_path"))
    found = base.select("doc_id", F.explode(findings_column("_text", "_path", forest)).alias("f"))
    out = found.select("doc_id", F.col("f.start").cast("long").alias("start"), F.length("f.value").cast("long").alias("length"), "f.value", F.round("f.score", 6).alias("score"))
    return out.withColumn("is_secret", F.col("score") >= threshold)


def redacted(docs: DataFrame, threshold: float = 0.5, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """docs with the occurrences that are secrets replaced by a mark, each at its place, and with them other occurrences of a value
    that is a secret somewhere in the same text. Equal characters inside a longer word stay. Other columns, rows and texts stay
    as they are, null and empty ones too."""
    forest = train(docs.sparkSession)
    text, shown = f"`{text_col}`", mark.replace("\\", "\\\\").replace("'", "\\'")
    secret, values = f"round(o.score, 6) >= {threshold}D", lambda yes: f"transform(filter(w.o, o -> {yes}), o -> o.value)"
    walk = f"transform({_walk(text, chr(39) * 2, forest)}, w -> struct(w.p as p, w.o as o, array_intersect({values(f'not ({secret})')}, {values(secret)}) as again))"
    kept = f"zip_with(slice(w.p, 1, size(w.o)), w.o, (y, o) -> concat(y, o.lead, if({secret} or array_contains(w.again, o.value), '{shown}', o.value)))"
    clean = F.expr(f"get(transform({walk}, w -> concat(array_join({kept}, ''), element_at(w.p, -1))), 0)")
    return docs.withColumn(text_col, F.when(F.col(text).rlike(CANDIDATE), F.coalesce(clean, F.col(text))).otherwise(F.col(text)))
