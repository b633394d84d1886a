"""Personal data by candidates and boosted trees, in DataFrame operators only.

Exact base patterns (e-mail, IP address, payment card with its check digit, international phone) always stay.
High-recall generators then propose overlapping spans (local phone numbers, cards with other separators, obfuscated
e-mail, account numbers, identity numbers, secrets); gradient-boosted trees score each candidate from its format and
context, a threshold per kind, calibrated on held-out examples, selects, and overlaps are resolved from the left.  The
trees are column expressions, so scoring stays in the JVM.

Training uses `EXAMPLES` generated sentences (a documented bound) whose features come from the same expressions.  They
come in three families with words, cues, separators, names and key forms of their own: the trees are grown on the first,
the thresholds are calibrated on the second (the lowest of a kind that keeps `PRECISION`), and the third only measures
precision and recall by kind (`evaluate_pii`).

Matches are found with possessive forms of the patterns, which match the same strings without recursion or quadratic
retries; offsets are code points, summed over the pieces between matches.  No pattern crosses a line end.

Defined results: null or empty text has no spans and the digest of the empty string; repeated rows get equal results;
extra columns are ignored.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._boost import Boosted
from tessella.llm._shared import whole_text

EXAMPLES = 1800
FAMILIES = 3
PRECISION = 0.97
KINDS = ("email", "ip", "card", "phone", "account", "identity", "secret")

#: The base patterns, in possessive form.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: kind of the generator, a cheap test of the text, the pattern
GENERATORS = (
    ("email", r"(?i)[(\[]at[)\]]", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[(\[]at[)\]] ?[a-z0-9-]++(?: ?[(\[]dot[)\]] ?[a-z0-9-]++|\.[a-z0-9-]++)++"),
    ("card", r"[0-9]{4}[./][0-9]{4}", r"(?<![0-9])[0-9]{4}[./][0-9]{4}[./][0-9]{4}[./][0-9]{4}(?![0-9])"),
    ("phone", r"[0-9]{3}[) .-]", r"(?<![0-9+])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("account", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("identity", r"[0-9]-[0-9]{2}-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("secret", r"(?i)(?:token|key|secret|passw|pwd)", r"(?i)(?<=(?:token|key|secret|password|passwd|pwd) ?[=:] ?[\"']?)[a-z0-9_+/=.-]{8,}"),
    ("secret", r"[0-9A-Fa-f]{32}", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])"),
    ("phone", r"0[0-9]{1,4}[ /.-][0-9]{2}", r"(?<![0-9+./-])0[0-9]{1,4}[ /.-][0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])"),
    ("secret", r"AKIA|gh[pousr]_|sk[_-]|xox[abprs]-|AIza", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk[_-](?:live_|test_)?[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,})(?![A-Za-z0-9_-])"),
)
CONTEXT = r"(?i)(?:tel|phone|call|fax|mobil|card|visa|ssn|social|iban|account|konto|cuenta|compte|token|key|secret|passw|pwd|mail|contact)[^.\n]{0,12}$"
FEATURES = ("generator", "length", "digits", "letters", "marks", "luhn", "context", "distinct", "mixed", "first", "quoted")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def located(text: Column, found: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> for the matches `found` of `pattern`: start and end in code points."""
    gaps = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"), m.alias("m")))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def step(acc, x):
        s = acc["at"] + x["gap"]
        e = s + x["len"]
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    walked = F.aggregate(gaps, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, walked).otherwise(none)


def luhn(digits: Column) -> Column:
    """True for a string of digits with a valid check digit."""
    back = F.split(F.reverse(digits), "")
    value = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _keep(kind: str):
    return lambda x: _valid(kind, x["m"])


def _tag(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))


def of_kind(kind: str):
    return lambda x: x["kind"] == kind


def base_spans(docs: DataFrame, text: str = "whole") -> DataFrame:
    """docs with an array b_<kind> of struct<s, e, m> for each base kind."""
    hint = {"email": "@", "phone": "+", "ip": "."}
    none = F.array().cast("array<string>")
    t = F.col(text)
    found = docs.withColumns({f"f_{k}": F.when(t.contains(hint[k]), matches(t, p)).otherwise(none) if k in hint else matches(t, p) for k, p in BASE.items()})
    spans = found.withColumns({f"b_{k}": F.filter(located(t, F.col(f"f_{k}"), p), _keep(k)) for k, p in BASE.items()})
    return spans.drop(*[f"f_{k}" for k in BASE])


def candidate_spans(docs: DataFrame, text: str = "whole") -> DataFrame:
    """docs with cand: array<struct<g, s, e, m, before, after>>."""
    none = F.array().cast("array<string>")
    t = F.col(text)
    found = docs.withColumns({f"g_{i}": F.when(t.rlike(test), matches(t, p)).otherwise(none) for i, (_, test, p) in enumerate(GENERATORS)})

    def described(i: int, p: str) -> Column:
        return F.transform(
            located(t, F.col(f"g_{i}"), p),
            lambda x: F.struct(
                F.lit(i).alias("g"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"),
                F.substring(t, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24))).alias("before"), F.substring(t, x["e"] + 1, F.lit(1)).alias("after"),
            ),
        )

    parts = found.withColumns({f"c_{i}": described(i, p) for i, (_, _, p) in enumerate(GENERATORS)})
    return parts.withColumn("cand", F.concat(*[F.col(f"c_{i}") for i in range(len(GENERATORS))])).drop(*[f"{x}_{i}" for x in "gc" for i in range(len(GENERATORS))])


def features(c: Column) -> list[Column]:
    m, d = c["m"], _digits(c["m"])
    letters = F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
    return [f.cast("double") for f in (
        c["g"], F.length(m), F.length(d), letters, F.length(m) - F.length(d) - letters,
        F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False), c["before"].rlike(CONTEXT), F.size(F.array_distinct(F.split(F.lower(m), ""))),
        (F.length(d) > 0) & (letters > 0), F.ascii(m).cast("double"), c["after"].isin('"', "'"),
    )]


def _example(r: random.Random, family: int) -> tuple[str, str, int, str]:
    """(words before, string, label, kind) of one generated candidate; of each list a family has its own third."""
    own = lambda *w: r.choice([x for i, x in enumerate(w) if i % FAMILIES == family])
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(n))
    words = " ".join(own("the", "of", "and", "report", "on", "page", "und", "der", "les", "para", "about", "version", "item", "at", "with", "il", "des", "por") for _ in range(r.randint(1, 5)))
    said = lambda *w: f"{words} {own(*w)} "
    hexes = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 64))))
    word = own("enabled", "required", "the-default", "configured", "undefined", "placeholder", "expired.now", "disabled", "see-below")
    name = own("ann", "bo.li", "jo_max", "info", "peter", "m.ruiz", "k-lee", "eva.schmidt", "office") + digits(r.choice((0, 0, 1, 2)))
    at, dot = own("(at)", "[at]", "(AT)"), own(" (dot) ", ".", " [dot] ")
    check = digits(15)
    total = sum(int(c) if i % 2 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(check))
    card, bad = check + str(-total % 10), check + str((-total + r.randint(1, 9)) % 10)
    cut, sep, slash = r.choice("./"), own(" ", ".", "-"), own(" ", "/", "-")
    four = lambda s: cut.join(s[i : i + 4] for i in range(0, 16, 4))
    area, mid, end = str(r.randint(201, 989)), digits(3), digits(4)
    key = own("token", "api key", "secret", "password", "pwd", "Token", "TOKEN", "API_KEY", "client_secret")
    bban = digits(16)
    vendor = own("AKIA" + letters(16).upper(), "ghp_" + letters(36), "sk_live_" + letters(24), "ghs_" + letters(30), "xoxb-" + digits(11) + "-" + letters(18), "AIza" + letters(35))
    phone = ("call", "phone", "tel", "fax", "mobile", "Telefon", "tel.", "phone:", "mobil")
    options = [
        (said("mail", "contact", "write to", "or", "by", "via"), f"{name} {at} {own('mail', 'post', 'web')}{digits(r.randint(0, 1))}.example{dot}{own('com', 'org', 'net')}", 1, "email"),
        (said("please", "we", "then", "and"), f"look {at} {word.split('.')[0]}{digits(r.choice((0, 0, 1)))}.{own('it', 'them', 'that')}", 0, "email"),
        (said("card", "visa", "pay", "charged", "amex", "mastercard"), four(card), 1, "card"), (said("table", "lot", "codes", "rows", "grid", "part"), four(bad), 0, "card"),
        (said(*phone), f"({area}) {mid}-{end}", 1, "phone"), (said(*phone), f"{area}{sep}{mid}{sep}{end}", 1, "phone"), (said("and", "to", "at"), f"({area}) {mid}-{end}", 1, "phone"),
        (said("lot", "rows", "from", "figures", "pages", "items"), f"{area} {mid} {end}", 0, "phone"), (said("ratio", "part", "build", "mean", "factor", "release"), f"{area}.{mid}.{end}", 0, "phone"),
        (said(*phone), f"0{digits(r.randint(1, 3))}{slash}{digits(3)}{own(' ', '-', '.')}{digits(4)}", 1, "phone"),
        (said("on", "dated", "am", "of", "le", "since"), f"0{r.randint(1, 9)}{sep}{r.randint(10, 12)}{sep}{r.randint(1980, 2029)}", 0, "phone"),
        (said("iban", "account", "konto", "cuenta", "IBAN", "compte"), f"DE{digits(2)} " + " ".join(bban[i : i + 4] for i in range(0, 16, 4)) + " " + digits(2), 1, "account"),
        (said("model", "part", "type", "unit", "plan", "code"), f"AB{digits(2)} " + " ".join(r.choice(("MAIN", "UNIT", "NEXT", "LINE")) for _ in range(4)), 0, "account"),
        (said("ssn", "social", "SSN", "number", "id", "nr", "for", "of", "with"), f"{r.randint(101, 665)}-{digits(2)}-{digits(4)}", 1, "identity"), (said("part", "model", "code", "item", "batch", "ref"), f"000-{digits(2)}-{digits(4)}", 0, "identity"),
        (f'{words} {key} = "', hexes, 1, "secret"), (f"{words} {key}{own(': ', '=', ' = ')}", r.choice((hexes[:20], letters(16), hexes)), 1, "secret"),
        (said("key", "use", "with", "export", "set", "found"), vendor, 1, "secret"), (f"{words} {key}: ", word, 0, "secret"),
        (said("use", "like", "as"), own("sk_test_", "ghp_", "AIza") + own("x", "0", "a") * 36, 0, "secret"),
        (said("commit", "checksum", "digest", "colour", "md5", "sha256"), r.choice((hexes, "0" * 32, digits(36))), 0, "secret"),
    ]
    return options[r.randrange(len(options))]


@dataclass
class PiiModel:
    trees: Boosted
    thresholds: dict[str, float]

    def selected(self, cand: Column) -> Column:
        """The candidates that pass, as array<struct<kind, s, e, score>>."""
        kinds = F.array(*[F.lit(k) for k, _, _ in GENERATORS])
        limits = F.array(*[F.lit(float(self.thresholds[k])) for k, _, _ in GENERATORS])
        scored = F.transform(cand, lambda c: F.struct(F.element_at(kinds, c["g"] + 1).alias("kind"), c["s"].alias("s"), c["e"].alias("e"), self.trees.column(features(c)).alias("score"), F.element_at(limits, c["g"] + 1).alias("limit")))
        return F.filter(scored, lambda c: c["score"] >= c["limit"])


def _described(spark: SparkSession, made: list[tuple[str, str, int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(example, features) of the candidates that the generators propose in the examples: a few rows for each."""
    sample = json.dumps([{"i": i, "whole": b + s + ('"' if b.endswith('"') else "") + " and more words", "lo": len(b), "hi": len(b) + len(s)} for i, (b, s, _, _) in enumerate(made)])
    rows = spark.sql("SELECT inline(from_json(:sample, 'array<struct<i:int,whole:string,lo:int,hi:int>>'))", args={"sample": sample})
    cands = candidate_spans(rows).select("i", "lo", "hi", F.explode("cand").alias("c")).filter("c.s < hi and c.e > lo")
    got = sorted(cands.select("i", *[f.alias(n) for n, f in zip(FEATURES, features(F.col("c")), strict=True)]).collect())
    return np.array([g["i"] for g in got], int), np.array([list(g)[1:] for g in got], float).reshape(len(got), len(FEATURES))


def _of_family(examples: int, seed: int, family: int) -> list[tuple[str, str, int, str]]:
    r = random.Random(seed * FAMILIES + family)
    return [_example(r, family) for _ in range(examples // FAMILIES)]


def fit_pii(spark: SparkSession, examples: int = EXAMPLES, seed: int = 3) -> PiiModel:
    """Trees from the first family of examples, thresholds from the second."""
    made = [_of_family(examples, seed, 0), _of_family(examples, seed, 1)]
    at, x = _described(spark, made[0] + made[1])
    y = np.array([(made[0] + made[1])[i][2] for i in at], float)
    test = at >= len(made[0])
    trees = Boosted.fit(x[~test], y[~test])
    p = trees.predict(x[test])
    limits = {}
    for kind in KINDS:
        own = np.array([GENERATORS[int(g)][0] == kind for g in x[test][:, 0]], bool)
        limits[kind] = 1.1
        for t in sorted(set(p[own][p[own] > 0.05])):
            chosen = own & (p >= t)
            if y[test][chosen].mean() >= PRECISION:
                limits[kind] = float(t)
                break
    return PiiModel(trees, limits)


def evaluate_pii(spark: SparkSession, model: PiiModel, examples: int = EXAMPLES, seed: int = 3) -> dict[str, tuple[float, float]]:
    """kind -> (precision, recall) on the third family; an example that no generator proposes counts as missed."""
    made = _of_family(examples, seed, 2)
    at, x = _described(spark, made)
    kinds = [GENERATORS[int(g)][0] for g in x[:, 0]]
    picked = {(i, k) for i, k, p in zip(at.tolist(), kinds, model.trees.predict(x), strict=True) if p >= model.thresholds[k]}
    out = {}
    for kind in sorted({k for _, _, _, k in made}):
        hits = [made[i][2] for i, k in picked if k == kind]
        true = [i for i, (_, _, y, k) in enumerate(made) if y and k == kind]
        out[kind] = (sum(hits) / max(len(hits), 1), sum((i, kind) in picked for i in true) / max(len(true), 1))
    return out


def find_pii(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, whole, base and spans as array<struct<kind, s, e>>; spans holds base ones first by
    kind, then start."""
    rows = candidate_spans(base_spans(docs.select(F.col(id_col), whole_text(text_col).alias("whole"))))
    tagged = [F.transform(F.col(f"b_{k}"), _tag(k)) for k in BASE]
    rows = rows.withColumn("base", F.concat(*tagged)).withColumn("more", model.selected(F.col("cand")))
    more = F.filter("more", lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    ordered = F.array_sort(F.transform(more, lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("x"), c["kind"].alias("kind"), c["e"].alias("e"))))
    none = F.array().cast("array<struct<kind:string,s:int,e:int>>")

    def step(acc, c):
        add = F.concat(acc["out"], F.array(F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"))))
        free = c["s"] >= acc["at"]
        return F.struct(F.when(free, c["e"]).otherwise(acc["at"]).alias("at"), F.when(free, add).otherwise(acc["out"]).alias("out"))

    rows = rows.withColumn("added", F.aggregate(ordered, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"]))
    rank = F.array(*[F.lit(k) for k in KINDS])
    everything = F.concat("base", "added")
    order = F.array_sort(F.transform(everything, lambda c: F.struct(F.array_position(rank, c["kind"]).alias("r"), c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))
    rows = rows.withColumn("spans", F.transform(order, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"))))
    return rows.select(id_col, "whole", "base", "spans")


def redact(found: DataFrame) -> DataFrame:
    """found with a column redacted: every span replaced by its kind in brackets (overlapping spans by the first)."""
    by_start = F.array_sort(F.transform("spans", lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("x"), c["e"].alias("e"), c["kind"].alias("kind"))))

    def step(acc, c):
        free = c["s"] >= acc["at"]
        keep = F.concat(acc["out"], F.substring("whole", acc["at"] + 1, c["s"] - acc["at"]), F.lit("["), c["kind"], F.lit("]"))
        return F.struct(F.when(free, c["e"]).otherwise(F.greatest(acc["at"], c["e"])).alias("at"), F.when(free, keep).otherwise(acc["out"]).alias("out"))

    end = F.aggregate(by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring("whole", acc["at"] + 1, F.length("whole"))))
    return found.withColumn("redacted", end)


def spans_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["s"].cast("string"), c["e"].cast("string"))), ",")
