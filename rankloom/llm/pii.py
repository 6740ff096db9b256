"""Personal data and secrets: keyed, type-consistent surrogates, in DataFrame functions only.

One pattern finds the entities of a text. An entity's canonical form (an e-mail in lower case, the last ten digits of a
phone number, one word of a name, ...) gives its surrogate by a keyed hash (HMAC of SHA-512), so that all mentions of it,
however formatted, get the same one. The key comes from the caller or from ``spark.rankloom.surrogateKey``; without one, each
run draws its own, and surrogates of different runs don't agree. The surrogate keeps kind, length and format: letters stay letters of their case,
digits digits, a card that passes the check-digit test passes it again, octets stay octets, a name keeps its gender and
script, an e-mail its top-level domain, a key its known beginning. An IPv6 address, short or in full, is replaced by one in full. A name after a neutral title (Dr, Prof) has
the gender that the same last name has elsewhere in the text, if that is one. Names without a title aren't found.

Distinct canonical forms of the whole corpus are checked for surrogates that collide, or that are themselves an entity of
the corpus; the later form of a collision takes its next attempt until none is left. With each attempt, names have a syllable
more, and local parts of e-mails, secrets and keys, from the fourth on, a letter more; formats of fixed length (numbers and
addresses) have, after ``FIXED`` attempts, a digit more. So no kind runs out of surrogates. A value without a letter or digit (``password: ________``)
is no secret. If the texts that hold such a form are at most
``BROADCAST``, they are broadcast as hashes; else only texts with an entity are joined to it. Text is never shuffled otherwise.

Cases: null and empty text stays as it is; text without entity is returned unchanged; null and repeated doc_ids are kept;
an empty table gives an empty result. ``pseudonymised`` keeps all columns of its input.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEY_SETTING = "spark.rankloom.surrogateKey"
#: Attempts after which fixed formats are lengthened; texts whose attempts are broadcast.
FIXED, BROADCAST = 20, 50_000

#: The patterns of the kinds of entities (Java syntax), tried in this order.
SECRET = r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b[\"']?\s{0,2}[=:]\s{0,2}[\"']?)(?=[+/_=-]*+[A-Za-z0-9])[A-Za-z0-9+/_=-]{8,}+[\"']?"
HEX = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "secret": SECRET,
    "email": r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[opsu]_[A-Za-z0-9]{36,}+|\bsk-(?=[_-]*+[A-Za-z0-9])[A-Za-z0-9_-]{20,}+|\bAIza(?=[_-]*+[A-Za-z0-9])[\w-]{35,}+|(?<![\w-])eyJ[\w-]{8,}+\.[\w-]{8,}+\.[\w-]{8,}+",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\w.+-])(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ipv6": rf"(?<![\w:])(?=:*[0-9A-Fa-f])(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}(?::{HEX}){{0,6}})?::(?:{HEX}(?::{HEX}){{0,6}})?)(?!\w|:[\w:]|\.\d)",
    "national_id": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w]|\.\d)|(?<![\w.])\+\d{9,14}(?!\w)",
    "name": r"(?<![\w])(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof)\b\.?|Herr|Frau|Monsieur|Madame|Mme|Señora?|г-н|г-жа|господин|госпожа|κύριος|κυρία) \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+){0,2}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these has no entity.
TRIGGER = r"[0-9@=:]|(?:AKIA|ASIA)[A-Z]|gh[opsu]_|sk-|AIza|eyJ|(?<!\w)(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|г-н|г-жа|господин|госпожа|κύριος|κυρία)\b"
#: Titles by gender, syllables and endings of surrogate names, letters of other scripts in the same order.
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|г-жа|госпожа|κυρία)\b"
MALE = r"^(?:Mr|Herr|Monsieur|Señor|г-н|господин|κύριος)\b"
SYLLABLES, PARTS = "kalemirosatevinobedafigalumaperi", 4
ENDINGS = {"f": "nalaraminasaditina", "m": "nomarortindensilus", "n": "renlinmertonselgar"}
LATIN, CYRILLIC, GREEK = "abdefgiklmnoprstuv", "абдефгиклмнопрстув", "αβδεφγικλμνοπρστυβ"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def kind_of(v: Column) -> Column:
    """The kind of an entity found by ``ANY``: the first pattern that it matches as a whole."""
    whole = [F.when(_is(v, f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()]
    return F.coalesce(*whole, F.lit("secret"))


def _number(h: Column, i: Column) -> Column:
    """A number under 65,536 for position i, from a hexadecimal hash of 128 digits."""
    return F.conv(F.substring(h, (i * 4) % 124 + 1, F.lit(4)), 16, 10).cast("int")


def _hash(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """HMAC of SHA-512."""
    block = key.encode()
    block = (hashlib.sha512(block).digest() if len(block) > 128 else block).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    message = F.concat_ws("|", kind, attempt.cast("string"), canon).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 512))), 512)


def _letter(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def _redrawn(value: Column, h: Column) -> Column:
    """Each letter and digit drawn anew from its own kind; all else stays. Lower hexadecimal stays hexadecimal."""
    def drawn(s):
        def draw(c, i):
            n = _number(h, i)
            lower = F.when(s["hexadecimal"], _letter("abcdef", n)).otherwise(_letter("abcdefghijklmnopqrstuvwxyz", n))
            return (
                F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[a-z]"), lower)
                .when(c.rlike("[A-Z]"), _letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)).otherwise(c)
            )
        return F.array_join(F.transform(F.split(s["value"], ""), draw), "")
    return let(F.struct(value.alias("value"), value.rlike("^[0-9a-f:]{8,}$").alias("hexadecimal")), drawn)


def _luhn(digits: Column, start: int) -> Column:
    """The check-digit sum; ``start`` 0: the last digit counts once, 1: twice."""
    def one(total, p):
        twice = p["d"] * ((p["i"] + start) % 2 + 1)
        return total + twice - F.when(twice > 9, 9).otherwise(0)
    pairs = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct(d.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(pairs, F.lit(0), one)


def _card(canon: Column, h: Column) -> Column:
    drawn = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(i == 0, c).otherwise((_number(h, i) % 10).cast("string"))), "")
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    checked = F.concat(body, ((10 - _luhn(body, 1) % 10) % 10).cast("string"))
    return F.when(_luhn(canon, 0) % 10 == 0, checked).otherwise(drawn)


def _name(canon: Column, h: Column, attempt: Column) -> Column:
    """A pronounceable word, longer with each attempt; canon is word|gender."""
    word, gender = F.substring_index(canon, "|", 1), F.substring_index(canon, "|", -1)
    body = F.array_join(F.transform(F.sequence(F.lit(1), attempt + PARTS), lambda i: F.substring(F.lit(SYLLABLES), _number(h, i) % 16 * 2 + 1, F.lit(2))), "")
    end = lambda g: F.substring(F.lit(ENDINGS[g]), _number(h, F.lit(0)) % 6 * 3 + 1, F.lit(3))
    latin = F.concat(body, F.when(gender == "f", end("f")).when(gender == "m", end("m")).otherwise(end("n")))
    return F.when(word.rlike(r"\p{IsCyrillic}"), F.translate(latin, LATIN, CYRILLIC)).when(word.rlike(r"\p{IsGreek}"), F.translate(latin, LATIN, GREEK)).otherwise(latin)


def surrogate_of(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical form."""
    def made(h):
        octets = F.concat_ws(".", *[(_number(h, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
        local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
        top = F.regexp_extract(domain, r"(\.[^.]*)$", 1)
        host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
        added = lambda after, draw: F.when(attempt > after, F.array_join(F.transform(F.sequence(F.lit(1), attempt - after), lambda i: draw(_number(h, i + 20))), "")).otherwise("")
        letters = added(3, lambda n: _letter("abcdefghijklmnopqrstuvwxyz", n))
        digits = added(FIXED, lambda n: (n % 10).cast("string"))
        hosts = let(_hash(F.lit("domain"), domain, F.lit(0), key), lambda g: _redrawn(host, g))
        # the area code and exchange of a phone number don't begin with 0 or 1
        phone = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when((F.length(canon) - i).isin(10, 7), _number(h, i) % 8 + 2).otherwise(_number(h, i) % 10).cast("string")), "")
        return (
            F.when(kind == "email", F.concat(_redrawn(local, h), letters, F.lit("@"), hosts, top)).when(kind == "ip", F.concat(octets, digits)).when(kind == "card", F.concat(_card(canon, h), digits))
            .when(kind == "phone", F.concat(phone, digits)).when(kind == "name", _name(canon, h, attempt))
            .when(kind == "access_key", F.concat(F.substring(canon, F.lit(1), F.lit(4)), _redrawn(F.substring(canon, F.lit(5), F.length(canon)), h), letters))
            .when(kind == "iban", F.concat(F.substring(canon, F.lit(1), F.lit(2)), _redrawn(F.substring(canon, F.lit(3), F.length(canon)), h), digits))
            .when(kind == "secret", F.concat(_redrawn(canon, h), letters)).otherwise(F.concat(_redrawn(canon, h), digits))
        )
    return let(_hash(kind, canon, attempt, key), made)


def _secret_parts(v: Column) -> list[Column]:
    return [F.regexp_extract(v, r"""^(.*?[=:]\s{0,2}["']?)([A-Za-z0-9+/_=-]+)(["']?)$""", k) for k in (1, 2, 3)]


def _gender(v: Column) -> Column:
    return F.when(v.rlike(FEMALE), F.lit("f")).when(v.rlike(MALE), F.lit("m")).otherwise(F.lit("n"))


def _name_words(v: Column) -> Column:
    return F.slice(F.split(v, " "), 2, 3)


def _last_word(v: Column) -> Column:
    return F.lower(F.element_at(_name_words(v), -1))


def _gendered(found: Column) -> Column:
    """Of the entities found in a text: each last word of a name with its gender, where the title tells that."""
    return F.array_distinct(F.transform(F.filter(found, lambda v: _gender(v) != "n"), lambda v: F.concat(_last_word(v), F.lit("|"), _gender(v))))


def _gender_here(v: Column, gendered: Column) -> Column:
    """The gender of a name; after a neutral title, that of the text's gendered mentions of its last word, if they agree."""
    def of(g):
        male, female = (F.array_contains(gendered, F.concat(_last_word(v), F.lit(f"|{x}"))) for x in "mf")
        return F.when(g != "n", g).when(male & ~female, F.lit("m")).when(female & ~male, F.lit("f")).otherwise("n")
    return let(_gender(v), of)


def _eight_groups(v: Column) -> Column:
    """An IPv6 address in lower case and in full."""
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    def full(low):
        head = groups(F.substring_index(low, "::", 1))
        tail = F.when(low.contains("::"), groups(F.substring_index(low, "::", -1))).otherwise(F.array().cast("array<string>"))
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(head) - F.size(tail), F.lit(0)))
        return F.array_join(F.transform(F.concat(head, zeros, tail), lambda g: F.lpad(g, 4, "0")), ":")
    return let(F.lower(v), full)


def canonical(v: Column, gendered: Column) -> Column:
    """Array of (kind, canon) of an entity of a text: one, but for a name one a word."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    def of(kind):
        canon = (
            F.when(kind == "email", F.lower(v)).when(kind == "phone", F.right(digits, F.lit(10))).when(kind.isin("card", "national_id"), digits)
            .when(kind == "iban", F.replace(v, F.lit(" "))).when(kind == "secret", _secret_parts(v)[1]).when(kind == "ipv6", _eight_groups(v)).otherwise(v)
        )
        words = let(_gender_here(v, gendered), lambda g: F.transform(_name_words(v), lambda w: F.struct(F.lit("name").alias("kind"), F.concat(F.lower(w), F.lit("|"), g).alias("canon"))))
        return F.when(kind == "name", words).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"))))
    return let(kind_of(v), of)


def _cased(original: Column, made: Column) -> Column:
    """``made``, with the letters in upper case that are so in ``original``, which is at most as long."""
    return F.array_join(F.zip_with(F.split(original, ""), F.split(made, ""), lambda c, m: F.when(c.rlike("[A-Z]"), F.upper(m)).otherwise(m)), "")


def _refilled(v: Column, longer: Column, size: Column) -> Column:
    """The last digits or letters of v, from the right, taken from the first ``size`` of ``longer``, and after them the rest of
    it; separators stay."""
    made = F.substring(longer, F.lit(1), size)
    def place(c, i):
        right = F.length(F.regexp_replace(F.substring(v, i + 1, F.length(v)), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]") & (right <= F.length(made)), F.substring(made, F.length(made) - right + 1, F.lit(1))).otherwise(c)
    return F.concat(F.array_join(F.transform(F.split(v, ""), place), ""), F.substring(longer, size + 1, F.length(longer)))


def rendered(v: Column, gendered: Column, attempts: Column | None, key: str) -> Column:
    """The surrogate of an entity as it stands in a text. attempts: map from kind:canon to the attempt, or None."""
    def made(p):
        tried = F.lit(0) if attempts is None else F.coalesce(F.element_at(attempts, F.concat(p["kind"], F.lit(":"), p["canon"])), F.lit(0))
        return surrogate_of(p["kind"], p["canon"], tried, key)
    def of(parts):
        kind, first = F.get(parts, F.lit(0))["kind"], made(F.get(parts, F.lit(0)))
        before, _, after = _secret_parts(v)
        title = F.substring_index(v, " ", 1)
        named = F.transform(F.arrays_zip(parts.alias("p"), _name_words(v).alias("w")), lambda x: let(made(x["p"]), lambda m: F.when(x["w"] == F.upper(x["w"]), F.upper(m)).otherwise(F.initcap(m))))
        return (
            F.when(kind == "name", F.concat_ws(" ", title, F.array_join(named, " "))).when(kind == "secret", F.concat(before, first, after))
            .when(kind == "email", let(first, lambda m: _cased(v, m))).when(kind.isin("phone", "card", "national_id", "iban"), let(first, lambda m: _refilled(v, m, F.length(F.get(parts, F.lit(0))["canon"]))))
            .when((kind == "ipv6") & v.rlike("[A-F]"), F.upper(first)).otherwise(first)
        )
    return let(canonical(v, gendered), of)


def _forms(docs: DataFrame, *keys: Column) -> DataFrame:
    """``keys``, kind and canon of the distinct forms of each text."""
    found = docs.where(F.col("text").rlike(TRIGGER)).select(*keys, F.regexp_extract_all("text", F.lit(ANY), 0).alias("found")).where(F.size("found") > 0)
    names = [c for c in found.columns if c != "found"]
    forms = let(_gendered(F.col("found")), lambda gendered: F.array_distinct(F.flatten(F.transform("found", lambda v: canonical(v, gendered)))))
    return found.select(*names, F.explode(forms).alias("e")).select(*names, "e.kind", "e.canon")


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, canon) of all texts."""
    return _forms(docs).distinct()


def collisions(found: DataFrame, key: str) -> DataFrame | None:
    """(kind, canon, attempt) of the forms that need another attempt than the first, or None."""
    current = common.staged(found.withColumn("attempt", F.lit(0)).withColumn("made", surrogate_of(F.col("kind"), F.col("canon"), F.col("attempt"), key)), "surrogates")
    again = None
    while True:  # each attempt from some on is longer, so that this ends
        first = current.groupBy("kind", "made").agg(F.min("canon").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
        later = current.join(first, ["kind", "made"]).where("canon <> owner").select("kind", "canon")
        real = current.select("kind", F.when(F.col("kind") == "name", F.substring_index("canon", "|", 1)).otherwise(F.col("canon")).alias("made")).distinct()
        real = current.join(real, ["kind", "made"], "left_semi").select("kind", "canon")
        losers = common.staged(later.unionByName(real).distinct().withColumn("lost", F.lit(True)), "losers")
        if not losers.limit(1).count():
            return again
        tried = current.join(losers, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.when(F.col("lost"), 1).otherwise(0))
        current = common.staged(tried.select("kind", "canon", "attempt", surrogate_of(F.col("kind"), F.col("canon"), F.col("attempt"), key).alias("made")), "surrogates")
        again = current.where("attempt > 0").select("kind", "canon", "attempt")


def pseudonymised(docs: DataFrame, key: str | None = None, most_broadcast: int = BROADCAST) -> DataFrame:
    """``docs`` with ``text`` (and ``n_chars``, where it is a column) after replacement."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None) or secrets.token_hex(32)
    retried = collisions(entities(docs), key)
    if retried is None:
        return _replaced(docs, docs.columns, key)
    attempts, at = _free("attempts", docs), _free("pii_hash", docs)
    own = _forms(docs, F.xxhash64("text").alias(at)).join(retried, ["kind", "canon"])
    own = own.groupBy(at).agg(F.map_from_entries(F.collect_set(F.struct(F.concat("kind", F.lit(":"), "canon"), "attempt"))).alias(attempts))
    own = common.staged(own, "retried")
    keyed = docs.withColumn(at, F.xxhash64("text"))
    if own.limit(most_broadcast + 1).count() <= most_broadcast:
        return _replaced(keyed.join(F.broadcast(own), at, "left"), docs.columns, key, attempts)
    held = F.coalesce(F.col("text").rlike(TRIGGER) & F.col("text").rlike(ANY), F.lit(False))
    return _replaced(keyed.where(held).join(own, at, "left"), docs.columns, key, attempts).unionByName(_replaced(docs.where(~held), docs.columns, key))


def _replaced(rows: DataFrame, columns: list[str], key: str, attempts: str | None = None) -> DataFrame:
    """``columns`` of the rows, with entities replaced, and their number."""
    found, gaps, text = _free("found", rows), _free("gaps", rows), _free("made", rows)
    rows = rows.withColumn(found, F.when(F.col("text").rlike(TRIGGER), F.regexp_extract_all("text", F.lit(ANY), 0)))
    rows = rows.withColumn(gaps, F.when(F.size(found) > 0, F.split("text", ANY, -1)))
    tried = None if attempts is None else F.col(attempts)
    surrogates = let(_gendered(F.col(found)), lambda gendered: F.concat(F.transform(F.col(found), lambda v: rendered(v, gendered, tried, key)), F.array(F.lit(""))))
    joined = F.array_join(F.flatten(F.zip_with(F.col(gaps), surrogates, lambda g, s: F.array(g, s))), "")
    changed = F.col(gaps).isNotNull()
    out, made = rows.withColumn(text, F.when(changed, joined).otherwise(F.col("text"))), {"text": F.col(text)}
    if "n_chars" in columns:
        made["n_chars"] = F.when(changed, F.length(text).cast(rows.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    count = "n_entities"
    while count in columns:
        count += "_"
    return out.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in columns], F.coalesce(F.greatest(F.size(found), F.lit(0)), F.lit(0)).alias(count))


def _free(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(common.documents(spark, sf_dir)).select("doc_id", "text", "n_entities")
