"""Personal data replaced by keyed surrogates.

Entities are e-mail addresses, telephone numbers, IP addresses of both versions, payment card numbers and IBANs (with valid check digits) and names
after a form of address or a label with a colon, with particles, hyphens and apostrophes, and with every later or earlier mention of such a name's words in the same text. An entity's parts (a mailbox, a domain, a name's
words, a number) are each brought to one spelling: letters without case, digits without the punctuation between them, Cyrillic family
names in their male form. The spelling is replaced by a function of a secret key, the part's kind and the spelling only, and what is made
is written the way the part was written. So one person, number or address reads the same in every document and in each of its spellings
(coreference) without a table of all entities. Replacements keep type and format: letters stay letters of their script and case, digits digits,
punctuation stays, country codes and check digits hold, Cyrillic family names keep their endings, given names keep the gender that the forms of
address tell: a name has one gender in the whole corpus, none if it comes with both.

Distinct parts must stay distinct. Where two parts of the corpus get one replacement, or a replacement is itself a part found in the corpus, all
but the first take another one (the next attempt), until there is no collision; names of all kinds are compared together. From attempt ``WIDE`` on letters are
drawn from the whole alphabet, from ``LONG`` on a replacement is longer than its part by one more character an attempt (not addresses, cards and IBANs,
whose billions of values are drawn on), so that short parts that use up their space get distinct ones too. Only these exceptions are stored; they are few, and
looked up by broadcast if their number allows, else by a join on the documents' parts.

Defined cases: a null text stays null and has no entities; rows are rewritten each, so repeated or null ids do no harm; texts without entities are
returned as they are; extra columns pass unchanged. A word that is a name in its text ("Mr May") is one wherever it stands there with a capital.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, fresh, small

# Forms of address by the gender they tell, Russian ones in all cases.
MALE = (
    "Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "M", "Signor", "Señor", "Sr", "господин", "господина", "господину", "господином", "господине", "г-н", "г-на", "г-ну",
)
FEMALE = (
    "Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Signora", "Signorina", "Señora", "Señorita", "Sra", "Srta", "госпожа", "госпожи", "госпоже", "госпожу", "госпожой", "г-жа", "г-жи", "г-же", "г-жу",
)
NEUTRAL = ("Dr", "Prof", "Professor")
# Words before a colon that announce a name, and particles within names.
LABELS = ("name", "full name", "contact person", "имя", "фио", "nom", "nombre", "nome")
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "ter", "ten", "zu", "bin", "ibn", "al")
# Country calling codes of one and two digits (all others have three); endings of Cyrillic family names, male and female.
ONE, TWO = ("1", "7"), "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
ENDINGS = (("ский", "ская"), ("цкий", "цкая"), ("ов", "ова"), ("ев", "ева"), ("ёв", "ёва"), ("ин", "ина"), ("ын", "ына"))

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*)@((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})")
PHONE = re.compile(r"(?<![\w+(])(?:\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{2}[ .-]?\d{2}|\+\d{1,3}(?:[ .-]\d{2,4}){3,4}|\+\d{10,14}|8[ -]?\(\d{3}\)[ -]?\d{3}-\d{2}-\d{2}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|0\d{1,4}[ /]\d{5,8})(?![\w.]\d|\w)")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)")
IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]|\.\d)")
CARD = re.compile(r"(?<![\w.])(?:\d{16}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|3[47]\d{13}|3[47]\d{2}([ -])\d{6}\2\d{5})(?!\w)")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)")
TITLE = "(?:" + "|".join(r"M(?=\.)" if t == "M" else t for t in sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True)) + ")"
#: A word of a name: a capital and letters, parts after hyphens and apostrophes (but no possessive), particles before it.
WORD = r"[^\W\d_a-zа-яё](?:[^\W\d_]+(?:[-'’](?!s(?!\w))[^\W\d_]+)*|['’](?!s(?!\w))[^\W\d_]{2,}(?:-[^\W\d_]+)*)"
WORDS = rf"((?:(?:{'|'.join(PARTICLES)})[  ])*{WORD}(?:[  ](?:(?:{'|'.join(PARTICLES)})[  ])*{WORD}){{0,2}})(?!\w)"
NAME = re.compile(rf"(?<!\w)({TITLE}(?:\.?[  ]+{TITLE})*)(\.?[  ]+){WORDS}")
LABELLED = re.compile(rf"(?<!\w)((?i:{'|'.join(LABELS)}))([  ]*:[  ]*){WORDS}")
DIGIT = re.compile(r"\d")
#: Two private-use characters around the number of a part that is already replaced.
OPEN, SHUT = "\ue000", "\ue001"
MARK = re.compile(f"{OPEN}(\\d+){SHUT}")
KINDS = ("email", "phone", "ip", "card", "iban", "name")


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def family(value: str) -> tuple[str, str, str]:
    """Stem, male ending, ending as written of a family name in lower case."""
    for male, female in ENDINGS:
        for end in (male, female):
            if value.endswith(end) and len(value) > len(end) + 1:
                return value[: -len(end)], male, end
    return value, "", ""


def spelling(kind: str, value: str) -> str:
    """The one form of a part's spellings."""
    if kind in ("phone", "card"):
        return ("+" if value[0] == "+" else "") + re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ip":
        return str(ipaddress.ip_address(value))
    low = value.lower()
    if len(low) != len(value):  # letters whose lower case is longer are left as they are
        low = value
    if kind == "family":
        stem, male, _ = family(low)
        return stem + male
    return low


def written(kind: str, made: str, value: str) -> str:
    """What is made for a part's spelling, in the way ``value`` is written."""
    if kind == "ip":
        return made
    if kind in ("phone", "card", "iban"):
        new = iter(made.lstrip("+"))
        out = "".join(next(new) if c.isalnum() else c for c in value)
        return out + "".join(new)
    if kind == "family":
        stem, male, end = family(value.lower())
        if end and len(value.lower()) == len(value):
            made = made[: len(made) - len(male)] + end
    if value.isupper() and len(value) > 1:
        return made.upper()
    return "".join(c.upper() if k < len(value) and value[k].isupper() else c for k, c in enumerate(made))


class Stream:
    """Keyed pseudo-random numbers for one part and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{value}\0{attempt}".encode(), hashlib.sha256).digest()
        self.block, self.left = 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest()
            self.block += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x % n

    def of(self, items: str) -> str:
        return items[self.below(len(items))]


#: The attempts from which letters are drawn from the whole alphabet, and from which replacements get longer.
WIDE, LONG = 8, 16
# Letters that stand in for vowels and consonants of a script, and its whole alphabet.
SCRIPTS = {"latin": ("aeiou", "bcdfghjklmnprstvz"), "cyrillic": ("аеиоу", "бвгдзклмнпрстф"), "greek": ("αειου", "βγδζκλμνπρστφ")}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def script(value: str) -> str:
    return "cyrillic" if re.search(r"[Ѐ-ӿ]", value) else "greek" if re.search(r"[Ͱ-Ͽ]", value) else "latin"


def letters(s: Stream, value: str, wide: bool = False) -> str:
    """Each letter by one of its script and case, vowels and consonants by turns or, if wide, any letter; digits by digits; the rest stays."""
    vowels, consonants = (ALPHABETS[script(value)],) * 2 if wide else SCRIPTS[script(value)]
    out, turn = [], s.below(2)
    for c in value:
        if c.isdigit():
            out.append(s.of("0123456789"))
        elif c.isalpha():
            x = s.of(vowels if turn else consonants)
            out.append(x.upper() if c.isupper() else x)
            turn = 1 - turn
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The replacement of a part's one spelling. kind: mailbox, domain, phone, ip, card, iban, family, given_m, given_f or given_n."""
    s = Stream(key, "name" if kind == "family" or kind.startswith("given") else kind, value, attempt)
    wide, more = attempt >= WIDE, max(0, attempt - LONG + 1)
    digits = lambda n: "".join(s.of("0123456789") for _ in range(n))

    def longer(x: str) -> str:
        of = "0123456789" if x.isdigit() else ALPHABETS[script(value)]
        new = "".join(s.of(of) for _ in range(more))
        return x + (new.upper() if x.isupper() and len(x) > 1 else new)

    if kind == "mailbox":
        return longer(letters(s, value, wide))
    if kind == "domain":
        labels = value.split(".")
        return ".".join([longer(letters(s, labels[0], wide)), *(letters(s, x, wide) for x in labels[1:-1]), labels[-1]])
    if kind == "phone":
        n = int(value[0] == "0") if value[0] != "+" else 2 if value[1] in ONE else 3 if value[1:3] in TWO else 4
        return value[:n] + digits(len(value) - n + more)
    if kind == "ip":
        if ":" in value:
            return str(ipaddress.ip_address("2001:db8:" + ":".join(f"{1 + s.below(65535):x}" for _ in range(6))))  # the range set aside for documentation
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "card":
        new = value[0] + digits(len(value) - 2) if len(value) == 16 else value[:2] + digits(len(value) - 3)
        return new + next(d for d in "0123456789" if luhn(new + d))
    if kind == "iban":
        new = value[:2] + "00" + "".join(s.of("0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in value[4:])
        return f"{new[:2]}{98 - mod97(new):02d}{new[4:]}"
    if kind == "family":
        stem, male, _ = family(value)
        return longer(letters(s, stem, wide)) + male
    name = longer(letters(s, value, wide))
    if kind in ("given_m", "given_f") and name[-1].isalpha():  # the ending tells the gender
        vowels, consonants = SCRIPTS[script(value)]
        end = vowels[0] if kind == "given_f" else s.of(consonants)
        name = name[:-1] + (end.upper() if name[-1].isupper() else end)
    return name


def _name_parts(titles: str, name: str) -> list[tuple[str, str]]:
    """(kind, word) of a name's words: the last is the family name, given names carry the gender that the first title with one tells."""
    gender = next(("m" if t in MALE else "f" for t in re.split(r"[.\s]+", titles) if t in MALE + FEMALE), "n")
    words = re.split(r"([  ])", name)
    last = len(words) - 1
    return [("" if w in "  " else "family" if k == last else f"given_{gender}", w) for k, w in enumerate(words)]


def rewrite(text: str, replaced: Callable[[str, str], str]) -> tuple[str, dict[str, int]]:
    """The text with each part passed through replaced(kind, value), and the number of entities by kind."""
    n = dict.fromkeys(KINDS, 0)

    def put(kind: str, by: Callable[[re.Match], str]) -> Callable[[re.Match], str]:
        def one(m: re.Match) -> str:
            n[kind] += 1
            return by(m)

        return one

    # an entity's replacement is not looked at again: it is held back behind a mark that no pattern matches
    held: list[str] = []

    def hold(x: str) -> str:
        held.append(x)
        return f"{OPEN}{len(held) - 1}{SHUT}"

    def valid(kind: str, good: Callable[[str], bool]) -> Callable[[re.Match], str]:
        one = put(kind, lambda m: hold(replaced(kind, m[0])))
        return lambda m: one(m) if good(m[0]) else m[0]

    out = text.replace(OPEN, OPEN + SHUT)  # a mark of the text's own
    if "@" in out:
        out = EMAIL.sub(put("email", lambda m: hold(f"{replaced('mailbox', m[1])}@{replaced('domain', m[2])}")), out)
    if DIGIT.search(out):
        out = IBAN.sub(valid("iban", lambda x: mod97(x.replace(" ", "")) == 1), out)
        out = CARD.sub(valid("card", lambda x: luhn(re.sub(r"\D", "", x))), out)
        out = IP.sub(put("ip", lambda m: hold(replaced("ip", m[0]))), out)
        out = PHONE.sub(put("phone", lambda m: hold(replaced("phone", m[0]))), out)
    if "::" in out or out.count(":") > 6:
        out = IP6.sub(valid("ip", _is_ip), out)
    known: dict[str, str] = {}

    def named(m: re.Match) -> str:
        for kind, w in (own := _name_parts(m[1], m[3])):
            if kind and len(w) > 1:
                known.setdefault(w, kind)
        return m[1] + m[2] + "".join(w if not kind else hold(replaced(kind, w)) for kind, w in own)

    out = NAME.sub(put("name", named), out)
    if ":" in out:
        out = LABELLED.sub(put("name", named), out)
    if known:  # the words of these names wherever else they stand
        every = {x: kind for w, kind in known.items() for x in (w, w.upper())}
        again = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(every, key=len, reverse=True))) + r")(?!\w)")
        out = again.sub(lambda m: hold(replaced(every[m[0]], m[0])), out)
    if held:
        out = MARK.sub(lambda m: held[int(m[1])], out)
    return out.replace(OPEN + SHUT, OPEN), n


def _is_ip(x: str) -> bool:
    try:
        return bool(ipaddress.ip_address(x))
    except ValueError:
        return False


def parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, value): the distinct parts of all texts, in their one spelling."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[tuple[str, str]] = set()

            def note(kind: str, value: str) -> str:
                found.add((kind, spelling(kind, value)))
                return value

            for t in b.column(0):
                rewrite(t.as_py(), note)
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["kind", "value"])

    return docs.select(F.col(text).alias("t")).where(F.col("t").isNotNull()).mapInArrow(of, "kind string, value string").distinct()


def exceptions(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, by, attempt): the parts whose first replacement collides, with the attempt that does not, and given names of several kinds; by: the
    kind that the replacement is made by."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column(0).to_pylist()
            made = [surrogate(key, k, v, n) for k, v, n in zip(kinds, b.column(1).to_pylist(), b.column(2).to_pylist())]
            odd = [k == "family" and family(x)[1] != family(x)[2] for k, x in zip(kinds, made)]  # it would read as the female form of another name
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string()), pa.array(odd, pa.bool_())], ["by", "value", "attempt", "made", "odd"])

    made = lambda rows: rows.mapInArrow(of, "by string, value string, attempt int, made string, odd boolean")
    space = F.when(F.col("by").rlike("^(family|given_.)$"), "name").otherwise(F.col("by")).alias("space")
    # a given name with forms of address of both genders has none
    genders = found.where("kind LIKE 'given_%'").groupBy("value").agg(F.collect_set("kind").alias("kinds")).where(F.size("kinds") > 1)
    m, f = F.array_contains("kinds", "given_m"), F.array_contains("kinds", "given_f")
    genders = cut(genders.select("value", F.when(m & ~f, "given_m").when(f & ~m, "given_f").otherwise("given_n").alias("_by")))
    kinds = found.join(small(genders), "value", "left").select("kind", "value", F.when(F.col("kind").startswith("given_"), F.col("_by")).alias("_by"))
    kinds = cut(kinds.select("kind", "value", F.coalesce("_by", "kind").alias("by")))
    taken = kinds.select(space, F.col("value").alias("made")).distinct().withColumn("taken", F.lit(True))

    def marked(rows: DataFrame, used: DataFrame) -> DataFrame:
        """rows with again: whether the replacement is used, or taken by a smaller part of the rows."""
        keeper = rows.groupBy("space", "made").agg(F.min(F.struct("value", "by")).alias("keeper"))
        again = F.col("odd") | F.coalesce("taken", F.lit(False)) | (F.col("keeper") != F.struct("value", "by"))
        return cut(rows.join(keeper, ["space", "made"]).join(used, ["space", "made"], "left").select("space", "by", "value", "attempt", "made", again.alias("again")))

    first = marked(made(kinds.select("by", "value").distinct().withColumn("attempt", F.lit(0))).select("*", space), taken)
    used = cut(taken.drop("taken").unionByName(first.where("not again").select("space", "made")))
    tried, done = first, first.where("attempt > 0")
    while tried.where("again").limit(1).count():
        rows = cut(made(tried.where("again").select("by", "value", (F.col("attempt") + 1).alias("attempt"))).select("*", space))
        hit = used.join(small(rows.select("space", "made")), ["space", "made"], "left_semi").distinct().withColumn("taken", F.lit(True))
        tried = marked(rows, hit)
        done, used = done.unionByName(tried.where("not again")), used.unionByName(tried.where("not again").select("space", "made"))
    other = cut(done.select("by", "value", "attempt"))
    return kinds.join(small(other), ["by", "value"], "left").where(F.col("attempt").isNotNull() | (F.col("kind") != F.col("by"))).select("kind", "value", "by", F.coalesce("attempt", F.lit(0)).alias("attempt"))


def anonymize(docs: DataFrame, key: bytes, text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with ``text`` rewritten, and n_email, n_phone, n_ip, n_card, n_name (replacing columns of these names)."""
    spark = docs.sparkSession
    found = cut(parts(docs, text))
    other = cut(exceptions(found, key))
    counts = [f"n_{k}" for k in KINDS]
    rows = docs.drop(*counts)
    names = rows.columns
    at = names.index(text)
    kinds = dict(docs.dtypes) | {text: "string"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", " + ", ".join(f"{c} long" for c in counts)
    few = other.limit(broadcast_rows + 1).count() <= broadcast_rows
    if few:
        shared = spark.sparkContext.broadcast({(r.kind, r.value): (r.by, r.attempt) for r in other.collect()})  # at most broadcast_rows
    else:  # the documents' own exceptions travel with them
        of, mine = fresh(rows, "_row"), fresh(rows, "_own")
        rows = rows.withColumn(of, F.struct(F.xxhash64(F.col(text)).alias("h"), F.length(text).alias("n")))
        here = rows.select(of, text).distinct().mapInArrow(_own_parts, "h long, n int, kind string, value string").join(other, ["kind", "value"])
        own = here.groupBy(F.struct("h", "n").alias("_own_row" + of)).agg(F.collect_set(F.struct("kind", "value", "by", "attempt")).alias(mine))
        rows = rows.join(own, F.col(of) == F.col("_own_row" + of), "left").select(*names, mine)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], str] = {}
        for b in batches:
            texts, ns = [], []
            for k, t in enumerate(b.column(at)):
                attempts = shared.value if few else {(x["kind"], x["value"]): (x["by"], x["attempt"]) for x in b.column(len(names))[k].as_py() or []}

                def by(kind: str, value: str, attempts=attempts) -> str:
                    one = spelling(kind, value)
                    if (kind, one) not in known:
                        if len(known) > 100_000:
                            known.clear()
                        made_by, attempt = attempts.get((kind, one), (kind, 0))
                        known[kind, one] = surrogate(key, made_by, one, attempt)
                    return written(kind, known[kind, one], value)

                new, n = rewrite(t.as_py(), by) if t.as_py() is not None else (None, dict.fromkeys(KINDS, 0))
                texts.append(new)
                ns.append(n)
            arrays = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array([n[k] for n in ns], pa.int64()) for k in KINDS]], [*names, *counts])

    return rows.mapInArrow(replace, schema)


def _own_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for row, t in zip(b.column(0).to_pylist(), b.column(1)):
            if t.as_py() is not None:
                mine: set[tuple[str, str]] = set()
                rewrite(t.as_py(), lambda kind, value, mine=mine: mine.add((kind, spelling(kind, value))) or value)
                out += [(row["h"], row["n"], *x) for x in sorted(mine)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out], pa.string())], ["h", "n", "kind", "value"])
