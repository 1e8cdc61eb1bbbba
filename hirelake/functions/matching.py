"""Column functions of matching: tokens, labels, grades, rates, locations, work formats, gates and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
PRIMARY_ALIASES = {
    "reactnative": "reactnative", "flutter": "flutter", "ios": "ios", "android": "android", "swift": "swift", "kotlin": "kotlin",
    "dotnet": "dotnet", "csharp": "dotnet", "vbnet": "dotnet", "aspnet": "dotnet", "cpp": "cplusplus", "cplusplus": "cplusplus", "c": "c",
    "java": "java", "python": "python", "php": "php", "go": "go", "golang": "go", "ruby": "ruby", "scala": "scala",
    "javascript": "javascript", "js": "javascript", "typescript": "typescript", "ts": "typescript", "nodejs": "nodejs",
    "react": "react", "reactjs": "react", "angular": "angular", "angularjs": "angular", "vue": "vue", "vuejs": "vue",
    "qa": "qa", "aqa": "qa", "devops": "devops", "sre": "devops",
    "systemanalyst": "systemanalyst", "системныйаналитик": "systemanalyst", "sa": "systemanalyst", "ca": "systemanalyst",
    "businessanalyst": "businessanalyst", "бизнесаналитик": "businessanalyst", "ba": "businessanalyst", "dataanalyst": "dataanalyst",
    "designer": "designer", "uxui": "designer", "uidesigner": "designer", "uxdesigner": "designer",
    "projectmanager": "projectmanager", "pm": "projectmanager", "productowner": "productowner", "po": "productowner",
    "productmanager": "productmanager", "salesforce": "salesforce", "1c": "1c", "sap": "sap",
}
PRIMARY_PATTERNS = (
    ("reactnative", r"\breact\s*native\b"),
    ("systemanalyst", r"\b(system\s*analyst|системн\w*\s+аналит\w*)\b"),
    ("businessanalyst", r"\b(business\s*analyst|бизнес\w*[- ]?аналит\w*)\b"),
    ("dataanalyst", r"\b(data\s*analyst|аналит\w*\s+данн\w*)\b"),
    ("productowner", r"\b(product\s*owner)\b"),
    ("productmanager", r"\b(product\s*manager)\b"),
    ("projectmanager", r"\b(project\s*manager|delivery\s*manager|scrum\s*master)\b"),
    ("designer", r"\b(designer|ux/ui|ui/ux|ux\s*designer|ui\s*designer|дизайнер)\b"),
    ("devops", r"\b(devops|platform\s*engineer)\b"),
    ("qa", r"\b(aqa|qa|quality\s*assurance|tester|тестиров\w*)\b"),
    ("flutter", r"\bflutter\b"),
    ("ios", r"\b(ios|objective[- ]?c)\b"),
    ("android", r"\bandroid\b"),
    ("swift", r"\bswift\b"),
    ("kotlin", r"\bkotlin\b"),
    ("dotnet", r"(?:^|[^a-z0-9])(?:\.net|dotnet|c#|csharp|vb\.?net|asp\.?net)(?:[^a-z0-9]|$)"),
    ("cplusplus", r"\b(c\+\+|cplusplus)\b"),
    ("c", r"(?:^|[^a-z0-9])c(?:[^a-z0-9]|$)"),
    ("java", r"\bjava\b(?!\s*script)"),
    ("python", r"\bpython\b"),
    ("php", r"\bphp\b"),
    ("go", r"\bgo(lang)?\b"),
    ("ruby", r"\bruby\b"),
    ("scala", r"\bscala\b"),
    ("nodejs", r"\bnode\.?\s*js\b"),
    ("react", r"\breact(?:\.js)?\b"),
    ("angular", r"\bangular(?:\.js)?\b"),
    ("vue", r"\b(vue(?:\.js)?|nuxt(?:\.js)?)\b"),
    ("typescript", r"\btypescript\b"),
    ("javascript", r"\bjavascript\b"),
    ("salesforce", r"\bsalesforce\b"),
    ("1c", r"(?:^|[^a-z0-9])(1c|1с)(?:[^a-z0-9]|$)"),
    ("sap", r"\bsap\b"),
)
TOOLING_ALIASES = ("docker", "git", "jira", "confluence", "figma", "postman", "jenkins", "nginx", "webpack", "vite", "storybook", "pvsstudio", "html", "css", "scss", "sass", "styledcomponents", "mui", "antd", "recharts", "axios", "ajax", "websocket", "protobuf")
TOOLING_PATTERNS = (
    ("pvsstudio", r"\bpvs[- ]?studio\b"), ("docker", r"\bdocker\b"), ("git", r"\bgit\b"), ("jira", r"\bjira\b"),
    ("confluence", r"\bconfluence\b"), ("figma", r"\bfigma\b"), ("postman", r"\bpostman\b"), ("jenkins", r"\bjenkins\b"),
    ("nginx", r"\bnginx\b"), ("webpack", r"\bwebpack\b"), ("vite", r"\bvite\b"), ("storybook", r"\bstorybook\b"),
    ("styledcomponents", r"\bstyled[- ]?components\b"),
)
#: What a text must hold in lower case, one of them, for a pattern to be found in it.
PATTERN_WORDS = {
    "reactnative": ("react",), "systemanalyst": ("analyst", "аналит"), "businessanalyst": ("analyst", "аналит"), "dataanalyst": ("analyst", "аналит"), "productowner": ("product",), "productmanager": ("product",),
    "projectmanager": ("manager", "master"), "designer": ("designer", "ux", "дизайнер"), "devops": ("devops", "platform"), "qa": ("qa", "quality", "test", "тестиров"), "ios": ("ios", "objective"),
    "dotnet": ("net", "c#", "csharp"), "cplusplus": ("c++", "cplusplus"), "nodejs": ("node",), "vue": ("vue", "nuxt"), "1c": ("1",), "pvsstudio": ("studio",), "styledcomponents": ("styled",),
}
#: Other letters that a pattern takes for these without regard to case, and lower() does not.
FOLDED = ("ıİſKᲀᲁᲂᲃᲄᲅᲆ", "iiskвдосттъ")
SECONDARY_STOPWORDS = ("unknown", "developer", "engineer", "specialist", "candidate", "vacancy", "роль", "stack")
GRADES = ("intern", "junior", "middle-", "middle", "middle+", "senior", "lead", "architect", "head", "staff", "principal")
GRADE_WORDS = (
    ("middle+", ("middle+", "middle +", "mid+", "мидл+")), ("middle-", ("middle-", "middle -", "mid-", "мидл-")),
    ("middle", ("middle", "mid", "мидл")), ("senior", ("senior", "sen", "сеньор")), ("junior", ("junior", "jun", "джун")),
    ("lead", ("lead", "лид")), ("architect", ("architect", "архитект")), ("head", ("head",)), ("staff", ("staff",)),
    ("principal", ("principal",)), ("intern", ("intern", "стаж")),
)
REMOTE_TOKENS = ("remote", "удаленка", "удаленно", "удалённо", "remotely")
RUSSIA_TOKENS = ("rf", "russia", "россия", "ru")
WORK_FORMATS = (("remote", r"\b(remote|remotely|home\s*office|wfh|удален\w*)\b"), ("hybrid", r"\b(hybrid|гибрид\w*)\b"), ("office", r"\b(office|onsite|on-site|on site|офис\w*|на месте)\b"))
TOKEN_WORDS = (("1с", "1c"), (".net", " dotnet "), ("c#", " csharp "), ("c++", " cpp "), ("react native", " reactnative "), ("node.js", " nodejs "), ("react.js", " reactjs "), ("vue.js", " vuejs "), ("angular.js", " angularjs "))
MATCH_THRESHOLD = 0.50
# ---- end of fixed values ----

#: Case-insensitive and Unicode-aware, as the rules were written for.
IU = "(?iU)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def given(value: Column, use) -> Column:
    """use(value), with the value worked out once: within a lambda an expression from outside would be worked out again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def distinct_keyed(values: Column, key) -> Column:
    """struct(v, k) of the first value of each non-blank key, in order, with the key."""
    keyed = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(v.alias("v"), key(v).alias("k")))
    none = F.array().cast("array<struct<v:string,k:string>>")
    known = lambda acc, s: (s["k"] == "") | F.exists(acc, lambda a: a["k"] == s["k"])
    return F.aggregate(keyed, none, lambda acc, s: F.when(known(acc, s), acc).otherwise(F.concat(acc, F.array(s))))


def distinct_by(values: Column, key) -> Column:
    """The first value of each non-blank key, in order."""
    return F.transform(distinct_keyed(values, key), lambda a: a["v"])


def match_token(x: Column | str) -> Column:
    t = F.lower(strip(F.coalesce(_c(x), F.lit(""))))
    for word, by in TOKEN_WORDS:
        t = F.replace(t, F.lit(word), F.lit(by))
    return F.regexp_replace(t, "[^a-z0-9а-я]+", "")


def urlish(x: Column | str) -> Column:
    return F.regexp_like(_c(x), F.lit(r"(?i)https?://|docs\.google\.com/|t\.me/"))


def match_texts(values: Column | str) -> Column:
    """Each text and its pieces, without links, once each regardless of case."""
    ends, none = r"[\n,;/|]|(?U:\s{2,})", F.array().cast("array<string>")
    texts = F.transform(F.coalesce(_c(values), none), lambda t: strip(F.coalesce(t, F.lit(""))))
    # stripped in a step before, and a text without an end of a piece is its only piece
    flat = F.flatten(F.transform(texts, lambda t: F.when(F.regexp_like(t, F.lit(ends)), F.concat(F.array(t), F.transform(F.split(t, ends), strip))).otherwise(F.array(t))))
    return distinct_by(F.filter(flat, lambda t: (t != "") & ~urlish(t)), F.lower)


def _labels(x: Column, token: Column, aliases: dict[str, str], patterns) -> Column:
    """The exact alias of the token, else every pattern that the text holds. A pattern is tried only where one of its words stands."""
    known = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
    stands = lambda low, label: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in PATTERN_WORDS.get(label, (label,))])
    found = given(F.lower(F.translate(x, *FOLDED)), lambda low: F.array_compact(F.array(*[F.when(stands(low, label) & F.regexp_like(x, F.lit(IU + p)), F.lit(label)) for label, p in patterns])))
    return F.when(F.map_contains_key(known, token), F.array(F.try_element_at(known, token))).otherwise(found)


def primary_labels(x: Column | str) -> Column:
    return given(match_token(x), lambda t: _labels(_c(x), t, PRIMARY_ALIASES, PRIMARY_PATTERNS))


def tooling_labels(x: Column | str) -> Column:
    return given(match_token(x), lambda t: _labels(_c(x), t, {a: a for a in TOOLING_ALIASES}, TOOLING_PATTERNS))


def _secondary(x: Column, token: Column) -> Column:
    good = ~F.regexp_like(token, F.lit(r"^\d*$")) & (F.length(token) >= 2) & ~token.isin(*SECONDARY_STOPWORDS) & ~urlish(x)
    return F.when(good, F.array(token)).otherwise(F.array().cast("array<string>"))


def secondary_tokens(x: Column | str) -> Column:
    return _secondary(_c(x), match_token(x))


def labels_of(texts: Column | str) -> Column:
    """For each struct(v: text, k: its token) struct(primary, tooling, secondary): the first kind that is found, the others empty."""
    none = F.array().cast("array<string>")
    # nested, so that primary labels are made once for each text
    first = F.transform(_c(texts), lambda s: F.struct(s["v"].alias("x"), s["k"].alias("t"), _labels(s["v"], s["k"], PRIMARY_ALIASES, PRIMARY_PATTERNS).alias("p")))
    tools = {a: a for a in TOOLING_ALIASES}
    second = F.transform(first, lambda s: F.struct(s["x"].alias("x"), s["t"].alias("t"), s["p"].alias("p"), F.when(F.size(s["p"]) > 0, none).otherwise(_labels(s["x"], s["t"], tools, TOOLING_PATTERNS)).alias("q")))
    last = lambda s: F.when((F.size(s["p"]) > 0) | (F.size(s["q"]) > 0), none).otherwise(_secondary(s["x"], s["t"]))
    return F.transform(second, lambda s: F.struct(s["p"].alias("primary"), s["q"].alias("tooling"), last(s).alias("secondary")))


def normalize_grade(x: Column | str) -> Column:
    t = F.lower(strip(_c(x)))
    out = None
    for grade, words in GRADE_WORDS:
        hit = reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])
        out = F.when(hit, F.lit(grade)) if out is None else out.when(hit, F.lit(grade))
    return out


def grade_level(x: Column | str) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, GRADES)), normalize_grade(x)), F.lit(0)) - 1


def grade_score(required: Column | str, candidate: Column | str) -> Column:
    """From levels: 0.5 if nothing is required, 0 if the candidate has none, else by distance."""
    r, c = _c(required), _c(candidate)
    far = F.abs(r - c)
    return F.when(r.isNull(), 0.5).when(c.isNull(), 0.0).when(far == 0, 1.0).when(far == 1, 0.6).when(far == 2, 0.25).otherwise(0.0)


def rate_anchor(high: Column | str | None, low: Column | str | None) -> Column:
    parts = [F.when(_c(x) > 0, _c(x).cast("double")) for x in (high, low) if x is not None]
    return F.coalesce(*parts)


def rate_score(budget: Column | str, ask: Column | str) -> Column:
    b, a = _c(budget), _c(ask)
    over = (a - b) / F.greatest(b, F.lit(1.0))
    return F.when(b.isNull() | a.isNull(), 0.0).when(a <= b, 1.0).when(over <= 0.10, 0.6).when(over <= 0.25, 0.25).otherwise(0.0)


def location_tokens(x: Column | str) -> Column:
    parts = F.split(F.lower(strip(F.coalesce(_c(x), F.lit("")))), r"(?U)[\s,;/|]+")
    return F.array_distinct(F.filter(F.transform(parts, match_token), lambda t: t != ""))


def location_score(left: Column | str, right: Column | str) -> Column:
    """From location tokens."""
    a, b = _c(left), _c(right)
    has = lambda x, words: F.arrays_overlap(x, F.array(*map(F.lit, words)))
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .when(F.arrays_overlap(a, b), 1.0)
        .when(has(a, REMOTE_TOKENS) & has(b, REMOTE_TOKENS), 1.0)
        .when(has(a, RUSSIA_TOKENS) & has(b, RUSSIA_TOKENS), 0.5)
        .otherwise(0.0)
    )


def work_formats(*texts: Column | str) -> Column:
    joined = F.concat_ws("\n", *[_c(t) for t in texts])
    return F.array_compact(F.array(*[F.when(F.regexp_like(joined, F.lit(IU + p)), F.lit(label)) for label, p in WORK_FORMATS]))


def format_gate(left: Column | str, right: Column | str) -> Column:
    return (F.size(_c(left)) == 0) | (F.size(_c(right)) == 0) | F.arrays_overlap(_c(left), _c(right))


def secondary_score(required: Column | str, candidate: Column | str) -> Column:
    r = F.array_distinct(_c(required))
    both = F.size(F.array_intersect(r, _c(candidate)))
    return F.least(F.lit(1.0), both / F.greatest(F.lit(1), F.least(F.size(r), F.lit(3))))


def semantic_score(*sims: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(*[_c(s) for s in sims], F.lit(0.0)).cast("double")))


def final_score(secondary: Column, grade: Column, rate: Column, location: Column, semantic: Column) -> Column:
    return F.round(F.lit(0.50) + 0.15 * secondary + 0.15 * grade + 0.10 * rate + 0.05 * location + 0.05 * semantic, 4)


def score_percent(sim: Column | str) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.bround(100 * F.coalesce(_c(sim), F.lit(0.0)), 0))).cast("int")
