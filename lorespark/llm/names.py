"""Spellings of names that mean the same person or organisation.

A string is read as a person (a given name, an initial, a shortened given name or a title, with a
surname) or as an organisation (a name with words of its kind).  A few well-known short forms of
given names and words for kinds are there to begin with; further ones are learned from the names
themselves: a short form by the rare surnames that it shares with a given name far more often than
by chance, and a word for a kind by standing behind many names that stand with little else.  A first word that is no known given
name is its own.  Surnames, organisations' names and such first words within one edit are found by
partitioning their metric space, see `metric`.  A full name is an entity; a form that leaves something out belongs to an entity if it fits that one only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.stats import binomial_tail
from lorespark.llm.metric import pairs_within_one
from lorespark.operators.components import connected_components
from lorespark.session import materialise

#: Usual short forms of given names in several languages (fixed values).
NICKNAMES = {
    "abigail": "abby abbie gail", "abraham": "abe bram", "adelaide": "addie ada", "agnes": "aggie nessa", "albert": "al bert albie", "alexander": "alex sasha xander sandy al lex", "alexandra": "alex sandra sasha lexi", "alfred": "alf alfie fred",
    "amanda": "mandy", "andrew": "andy drew", "angela": "angie", "anneliese": "anne liese anni lisl", "anthony": "tony ant", "arthur": "art artie", "augustus": "gus", "barbara": "barb babs barbie",
    "beatrice": "bea trixie", "benjamin": "ben benny benji", "bernard": "bernie", "bridget": "bridie biddy", "caroline": "carrie caro", "catherine": "cathy cate cat", "cecilia": "cissy celia", "charles": "charlie chuck chas",
    "charlotte": "charlie lottie lotte", "christina": "chris tina chrissy", "christopher": "chris kit topher", "constance": "connie", "cornelius": "neil", "cynthia": "cindy", "daniel": "dan danny", "david": "dave davey",
    "deborah": "deb debbie debby", "dmitri": "dima mitya", "dominic": "dom", "donald": "don donnie", "dorothy": "dot dottie dolly dora", "douglas": "doug", "edith": "edie", "edward": "ed eddie ted ned teddy",
    "edwin": "ed eddie", "ekaterina": "katya kate katja katia", "eleanor": "ellie nell nora ella", "elizabeth": "liz beth betty lizzie eliza lisa libby bess", "emily": "em emmy", "ernest": "ernie", "eugene": "gene", "evelyn": "evie",
    "fernando": "nando", "florence": "flo flossie", "frances": "fran frankie fanny", "francis": "frank fran", "francisco": "paco pancho frank cisco", "frederick": "fred freddie freddy rick", "friederike": "rike fritzi frieda rieke", "friedrich": "fritz",
    "gabriel": "gabe", "gabriela": "gabi", "geoffrey": "geoff", "george": "georgie", "gerald": "gerry jerry", "gertrude": "trudy gert", "gilbert": "gil bert", "giovanni": "gianni",
    "giuseppe": "beppe peppe", "gregory": "greg", "guadalupe": "lupe lupita", "gwendolyn": "gwen", "harold": "harry hal", "harriet": "hattie", "heinrich": "heinz heini", "helen": "nell nellie",
    "henry": "harry hank hal", "herbert": "herb bert", "howard": "howie", "ignacio": "nacho", "isaac": "ike", "isabella": "bella izzy isa belle", "jacob": "jake", "jacqueline": "jackie",
    "james": "jim jimmy jamie", "jeffrey": "jeff", "jennifer": "jen jenny jenn", "jeremiah": "jerry", "jessica": "jess jessie", "jesus": "chuy", "joanna": "jo", "johannes": "hans jo hannes",
    "jonathan": "jon jonny john nathan", "josef": "sepp", "jose": "pepe", "joseph": "joe joey jo", "josephine": "jo josie", "joshua": "josh", "judith": "judy jude", "julia": "julie jules",
    "katherine": "kathy kate katie kat kath kitty", "kenneth": "ken kenny", "kimberly": "kim", "konstantin": "kostya costa kosta", "lawrence": "larry lars laurie", "leonard": "len lenny leo", "leopold": "leo poldi", "lillian": "lily lil",
    "louis": "lou louie", "luis": "lucho", "magdalena": "magda lena", "manuel": "manny manolo", "margaret": "maggie meg peggy greta marge daisy", "maria": "mia", "martin": "marty", "mary": "molly polly mae",
    "matthew": "matt matty", "maximilian": "max", "melissa": "mel missy", "michael": "mike mick mickey", "mikhail": "misha", "mildred": "millie", "miriam": "mimi", "natalia": "natasha",
    "natalie": "nat", "nathaniel": "nate nat nathan", "nicholas": "nick nicky klaus", "nikolai": "kolya", "olga": "olya", "oliver": "ollie", "olivia": "liv", "pamela": "pam",
    "patricia": "pat patty trish tricia patti", "patrick": "pat paddy", "pavel": "pasha", "peter": "pete", "philip": "phil pip", "priscilla": "cilla", "raymond": "ray", "rebecca": "becky becca bec",
    "reginald": "reg reggie", "richard": "rich rick dick ricky richie", "robert": "bob rob bobby robbie bert", "roberto": "beto", "roderick": "rod", "ronald": "ron ronnie", "rosemary": "rosie", "rudolf": "rudi",
    "russell": "russ", "samantha": "sam", "samuel": "sam sammy", "sarah": "sally sadie", "sebastian": "seb bastian", "sergei": "seryozha", "solomon": "sol", "stanley": "stan",
    "stephen": "steve stevie", "susan": "sue susie suzy", "svetlana": "sveta", "tatiana": "tanya", "theodore": "theo ted teddy", "theresa": "tess terry", "thomas": "tom tommy", "timothy": "tim timmy",
    "valentina": "valya tina val", "veronica": "ronnie", "victor": "vic", "victoria": "vicky tori vicki vic", "vincent": "vince vinny vin", "virginia": "ginny", "vladimir": "vova volodya", "walter": "walt",
    "wilhelm": "willi", "wilhelmina": "mina", "william": "bill will billy liam willie", "winifred": "winnie", "wolfgang": "wolf wolfi", "yevgeny": "zhenya", "zachary": "zach zack zac",
}
#: Words in front of a surname (fixed values).
TITLES = frozenset("dr prof professor doctor mr mrs ms mx miss sir dame herr frau señor señora".split())
#: Usual words that say what kind of organisation a name means (fixed values).
KINDS = frozenset(
    "academy agency airline airlines alliance architects archive arena association bakery bank board bookshop boutique brewery brothers builders bureau cafe catering center chamber choir cinema circus clinic climbing club coalition college commission committee community company construction consulting cooperative corporation council dairy dental department diner distillery electric electronics embassy energy engineering enterprises equipment exchange factory federation festival films finance fitness florist forum foundation furniture gallery garage group gym health hospital hotel house industries institute insurance kindergarten kitchen laboratory laundry league library logistics media ministry mission municipal museum network nursery office optics orchestra outfitters partners pharmacy photography pizzeria police practice press productions properties publishing railway repair research restaurant salon school security services shelter shipping shop society software solutions stables station store studio supermarket supplies surgery synagogue systems tailors team technology telecom temple theatre tours training transport travel trust union university veterinary vineyard warehouse winery workshop".split()
)
#: Words for the same kind (fixed values).
SAME_KIND = {"airlines": "airline", "centre": "center", "labs": "laboratory", "shop": "workshop", "theater": "theatre"}
#: What an organisation's name may end with or begin with (fixed values).
LEGAL = frozenset("ltd limited inc incorporated llc gmbh ag co corp corporation plc e v ev kg and of the for".split())
_ENDS = LEGAL - {"and", "of", "the", "for", "e", "v"}
#: Different given names up to which a surname is rare enough to learn short forms from; surnames
#: that a short form must share with a given name, the share of its own that these must be, and the
#: chance of so many by accident; names that a word for a kind must stand behind, the share of these that must stand
#: with at most half as many words as it does names, and the share of its strings in which it may stand as a surname does.
RARE, SHARED, SHARE, CHANCE, NAMES, APART, AS_SURNAME = 8, 2, 0.5, 1e-4, 8, 0.8, 0.02
#: Letters of a name from which on one edit may be a slip.
SLIP_LETTERS = 4
_BY_NICK: dict[str, frozenset[str]] = {}
for _formal, _short in NICKNAMES.items():
    for _nick in _short.split():
        _BY_NICK[_nick] = _BY_NICK.get(_nick, frozenset()) | {_formal}

_PARENTHESES = re.compile(r"\([^)]*\)|\[[^\]]*\]")
_POSSESSIVE = re.compile(r"['’`´]s\b", re.I)
_JOINED = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])")
_TOKEN = re.compile(r"[^\W_]+")
#: A word of three letters or more without a vowel, as short forms are.
_SKELETON = re.compile(r"[^\W\d_aeiouyäöüаеиоуыэюя]{3,}")
_SPECIAL = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i"})


#: Letters that are spelled in two ways for one sound (fixed values).
_SOUND = ((re.compile("sch"), "sh"), (re.compile("ck|c(?!h)"), "k"), (re.compile("ph"), "f"))


def sound(word: str) -> str:
    for pattern, plainer in _SOUND:
        word = pattern.sub(plainer, word)
    return word


def plain(text: str) -> str:
    text = unicodedata.normalize("NFD", text.casefold())
    return "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf")).translate(_SPECIAL)


@lru_cache(maxsize=100_000)
def _given(token: str, lexicon: frozenset[str]) -> tuple[str, ...]:
    """The given names that a word may stand for; none if it is no given name."""
    if token in NICKNAMES or token in lexicon:
        return (token,)
    if token in _BY_NICK:
        return tuple(sorted(_BY_NICK[token]))
    if len(token) < 4 or token in KINDS:
        return ()
    close = sorted(g for g in {*NICKNAMES, *lexicon} if g[0] == token[0] and abs(len(g) - len(token)) <= 1 and _one_slip(token, g))
    close = close or sorted(g for g in {*NICKNAMES, *lexicon} if len(g) > 4 and abs(len(g) - len(token)) <= 1 and _one_slip(token, g))
    if not close:
        close = sorted({f for n, fs in _BY_NICK.items() if len(n) >= 4 and len(token) >= 4 and _one_slip(token, n) for f in fs})
    return tuple(close)


def _one_slip(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def _shortens(short: str, word: str) -> bool:
    """Whether the letters of ``short`` stand in ``word`` in order, the first at its beginning."""
    letters = iter(word)
    return 2 <= len(short) < len(word) - 1 and short[0] == word[0] and all(c in letters for c in short)


@lru_cache(maxsize=100_000)
def _kind_words(token: str, kinds: frozenset[str]) -> tuple[str, ...]:
    """The kinds of organisation that a word may mean: also shortened or with a slip."""
    close = [token] if token in kinds else []
    if not close and len(token) >= 3:
        close = [k for k in kinds if k.startswith(token) and len(token) <= min(6, len(k) - 2)]
        close = close or [k for k in kinds if len(k) >= 4 and _one_slip(token, k)]
    if not close and len(token) <= 6:
        close = [k for k in kinds if _shortens(token, k)]
    return tuple(sorted({SAME_KIND.get(k, k) for k in close}))


def _tokens(name: str) -> tuple[list[str], list[str], list[str]]:
    """The words of a name, as they stand and folded, and its parts between commas."""
    text = _POSSESSIVE.sub("", unicodedata.normalize("NFKC", _PARENTHESES.sub(" ", name)))
    if not text.isupper():
        text = _JOINED.sub(" ", text)
    raw = _TOKEN.findall("".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf"))
    return raw, [plain(t) for t in raw], [p for p in text.split(",") if p.strip()]


def read(name: str, kinds: frozenset[str] = KINDS, lexicon: frozenset[str] = frozenset()) -> tuple[str, str, str, list[str]] | None:
    """(kind, key, form, fits) of a name, or none if it names no particular person or organisation.

    ``key`` is the surname or the organisation's own name.  ``form`` is ``full`` with one entry in
    ``fits``, the given name or the kind of organisation; ``some`` with the given names that it may
    be; ``initial`` with the first letters of the given name; ``part`` with a word of the kind or
    ``acronym`` with its first letters; or ``title`` with none.
    """
    raw, words, comma = _tokens(name)
    if not words or all(w.isdigit() for w in words):
        return None
    if len(raw) == 2 and _letters(raw[1]) and len(words[0]) >= 4 and not _given(words[0], lexicon):
        return "org", sound(words[0]), "acronym", ["".join(sorted(words[1]))]
    # Organisations: words of a kind, or letters of one behind a name.
    body = [(w, r) for w, r in zip(words, raw) if w not in LEGAL]
    sure = [w in kinds for w, _ in body]
    if sum(sure) == 1 and len(body) == 2 and sure[1] and body[0][0] in NICKNAMES:
        sure = [False, False]  # a person whose surname is such a word
    told: list[tuple[str, ...]] = [()] * len(body)
    if any(sure):
        told = [_kind_words(w, kinds) if k or (i and not _given(w, lexicon)) else () for i, ((w, _), k) in enumerate(zip(body, sure))]
    elif len(body) >= 3 and body[0][0] not in TITLES and not _person(words, raw, comma, lexicon):
        told = [_kind_words(w, kinds) if i else () for i, (w, _) in enumerate(body)]
        told = told if sum(map(bool, told)) >= 2 else [()] * len(body)
    elif len(body) == 2 and not _given(body[0][0], lexicon) and _SKELETON.fullmatch(body[1][0]):
        told = [(), _kind_words(body[1][0], kinds)]
    if any(told):
        own = [w for k, (w, _) in zip(told, body) if not k]
        if len("".join(own)) < 2:
            return None
        found = sorted({k[0] for k in told if len(k) == 1})
        whole = len(found) > 1 and all(len(k) < 2 for k in told)
        return "org", sound("".join(own)), "full" if whole else "part", [" ".join(found)]
    ended = [w for w in words if w not in _ENDS]
    if len(ended) < len(words) and len(ended) >= 2 and words[0] != "the":
        if _given(ended[0], lexicon):
            return "org", sound("".join(ended)), "part", [""]
        words, raw = ended, [r for w, r in zip(words, raw) if w not in _ENDS]
    return _person(words, raw, comma, lexicon, unknown=True)


def _letters(word: str) -> bool:
    """First letters of the words of a kind."""
    return 2 <= len(word) <= 4 and word.isupper()


def _person(words: list[str], raw: list[str], comma: list[str], lexicon: frozenset[str], unknown: bool = False) -> tuple[str, str, str, list[str]] | None:
    titled = False
    if len(comma) == 2 and len(words) >= 2:  # the surname comes first
        behind = len(_TOKEN.findall(comma[1]))
        words, raw = words[-behind:] + words[:-behind], raw[-behind:] + raw[:-behind]
    while words and words[0] in TITLES:
        words, raw, titled = words[1:], raw[1:], True
    if not words or words[0] == "the":
        return None
    if len(words) == 1:
        return ("person", sound(words[0]), "title", []) if titled and len(words[0]) >= 2 and not _given(words[0], lexicon) else None
    first, rest = words[0], words[1:]
    given = _given(first, lexicon)
    if not given and len(first) > 1:
        last = _given(words[-1], lexicon)
        dotted = len(first) in (2, 3)
        if last and not dotted:  # the surname comes first without a comma
            first, rest, given = words[-1], words[:-1], last
    rest = [w for i, w in enumerate(rest) if len(w) > 1 or i == len(rest) - 1]  # middle initials
    surname = sound("".join(rest))
    if len(surname) < 2 or any(w in LEGAL for w in rest if len(w) > 1):
        return None
    if given:
        return "person", surname, "full" if len(given) == 1 else "some", list(given)
    if len(first) == 1:
        return "person", surname, "initial", [first]
    if len(first) <= 4 and any(g.startswith(first) for g in {*NICKNAMES, *lexicon}):
        return "person", surname, "initial", [first]
    return ("person", surname, "full", [first]) if unknown else None


def all_names(extractions: DataFrame, edges: DataFrame) -> DataFrame:
    """(name): the different strings of entities, subjects and objects; nulls and empty ones left out."""
    parts = [extractions.select(F.explode("entities").alias("name")), edges.select(F.col("subj").alias("name")), edges.select(F.col("obj").alias("name"))]
    return parts[0].union(parts[1]).union(parts[2]).filter("name is not null and name != ''").distinct()


def _parsed(names: DataFrame, kinds: frozenset[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(n, *r) for n in batch.name if (r := read(n, kinds))]
            yield pd.DataFrame(out, columns=["name", "kind", "key", "form", "fits"])

    return names.mapInPandas(run, "name string, kind string, key string, form string, fits array<string>")


def learned_kinds(names: DataFrame) -> frozenset[str]:
    """Words for kinds of organisations that stand in the strings of a column ``name``.

    Such a word stands behind many first words, nearly all of which stand before few words: given
    names, which stand before very many surnames, do not.  It hardly ever stands behind a title or an initial or before a comma, as surnames do, and seldom
    first.  No more of them than an eighth of the strings come to the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name in batch.name:
                raw, words, comma = _tokens(name)
                titled = bool(words) and words[0] in TITLES
                words = [w for w in words if w not in LEGAL and w not in TITLES]
                if titled or len(comma) > 1 or (len(words) == 2 and min(map(len, words)) == 1):
                    out += [(None, w) for w in words if len(w) > 2]  # a surname, or a given name before one
                elif 2 <= len(words) <= 6:
                    out += [(words[0], w) for w in words[1:] if len(w) > 2 and len(words[0]) > 2]
            yield pd.DataFrame(out, columns=["own", "word"])

    pairs = materialise(names.mapInPandas(run, "own string, word string"))
    behind = pairs.filter("own is not null").distinct()
    wide = behind.groupBy("word").agg(F.count("*").alias("names")).filter(F.col("names") >= NAMES)
    before = behind.groupBy("own").agg(F.count("*").alias("words"))
    surname = pairs.groupBy("word").agg(F.avg(F.col("own").isNull().cast("double")).alias("as_surname"))
    apart = behind.join(wide, "word").join(before, "own").groupBy("word").agg(F.max("names").alias("names"), F.avg((F.col("words") * 2 <= F.col("names")).cast("double")).alias("apart"))
    seldom = apart.join(surname, "word").join(before.withColumnRenamed("own", "word"), "word", "left").filter((F.col("apart") >= APART) & (F.col("as_surname") <= AS_SURNAME) & (F.coalesce("words", F.lit(0)) * 3 <= F.col("names")))
    found = {r.word: r.names for r in seldom.select("word", "names").collect()}
    often = found | dict.fromkeys(KINDS, float("inf"))
    # A word that shortens or misspells one that stands behind more names means the same.
    same = {w for w, n in found.items() if w not in KINDS and any(m > n and (_shortens(w, k) or (len(k) >= 4 and _one_slip(w, k))) for k, m in often.items())}
    return frozenset(found.keys() - same)


def learned_shorts(entities: DataFrame) -> DataFrame:
    """(short, formal): first words that mean a given name, from (kind, key, value) of full names.

    Of the surnames that stand with few first words, those with the short form must mostly stand with the
    given name as well, and more often than could be by chance.
    """
    people = entities.filter("kind = 'person'").select("key", "value")
    rare = people.groupBy("key").agg(F.count("*").alias("n")).filter(f"n <= {RARE}").select("key")
    some = materialise(people.join(rare, "key"))
    keys = float(rare.count() or 1)
    sizes = some.groupBy("value").agg(F.count("*").alias("n"))
    both = some.select("key", F.col("value").alias("short")).join(some.select("key", F.col("value").alias("formal")), "key").filter("short != formal").groupBy("short", "formal").agg(F.count("*").alias("shared")).filter(f"shared >= {SHARED}")
    sized = both.join(sizes.select(F.col("value").alias("short"), F.col("n").alias("n_short")), "short").join(sizes.select(F.col("value").alias("formal"), F.col("n").alias("n_formal")), "formal")
    likely = sized.filter(f"shared >= {SHARE} * n_short and (n_short < n_formal or (n_short = n_formal and short < formal))")
    return likely.filter(binomial_tail(F.col("n_short"), F.col("shared"), F.col("n_formal") / keys) < CHANCE).select("short", "formal")


def _short_links(entities: DataFrame, both: DataFrame) -> DataFrame:
    """(x, y): entities by a learned short form and the one entity of its surname that it fits."""
    shorts = F.broadcast(materialise(learned_shorts(entities)))
    name = lambda key, value: F.concat_ws("|", F.lit("person"), key, value)
    people = entities.filter("kind = 'person'")
    asked = people.join(shorts, people.value == shorts.short).select("key", "short", "formal")
    formal = people.select("key", F.col("value").alias("formal"))
    own = asked.join(formal, ["key", "formal"]).select("key", "short", F.col("key").alias("at"), "formal")
    away = asked.join(both, asked.key == both.a).select("key", "short", F.col("b").alias("at"), "formal").join(formal.withColumnRenamed("key", "at"), ["at", "formal"]).join(own.select("key", "short").distinct(), ["key", "short"], "left_anti")
    fits = own.unionByName(away).groupBy("key", "short").agg(F.min(F.struct("formal", "at")).alias("fit"), F.count_distinct("formal").alias("n")).filter("n = 1")
    return fits.select(name("key", "short").alias("x"), name("fit.at", "fit.formal").alias("y"))


def _sound(column: str):
    """As `sound`, of a column."""
    out = F.col(column)
    for pattern, plainer in _SOUND:
        out = F.regexp_replace(out, pattern.pattern, plainer)
    return out


def _unknown_given(entities: DataFrame) -> DataFrame:
    """(x, y): entities whose first word is no known given name that mean the same person.

    With the same surname, one letter inside the first word differs, and one of the two words is
    no one else's first word (else they are two names); or the words stand the other way round.
    """
    known = entities.sparkSession.createDataFrame([(n,) for n in NICKNAMES], "value string")
    own = materialise(entities.filter("kind = 'person'").join(F.broadcast(known), "value", "left_anti"))
    name = lambda key, value: F.concat_ws("|", F.lit("person"), key, value)
    others = own.groupBy("value").agg(F.count("*").alias("n"))
    close = pairs_within_one(own.filter(f"length(value) > {SLIP_LETTERS}").select("value").distinct(), "value").filter("left(a, 1) = left(b, 1) and right(a, 1) = right(b, 1)")
    rare = close.join(others.select(F.col("value").alias("a"), F.col("n").alias("na")), "a").join(others.select(F.col("value").alias("b"), F.col("n").alias("nb")), "b").filter("na = 1 or nb = 1").select("a", "b")
    slips = own.select("key", F.col("value").alias("a")).join(rare, "a").join(own.select("key", F.col("value").alias("b")), ["key", "b"]).select(name("key", "a").alias("x"), name("key", "b").alias("y"))
    heard = own.withColumn("sound", _sound("value"))
    turned = heard.select(F.col("key").alias("k"), F.col("value").alias("v"), F.col("sound").alias("key"), F.col("key").alias("sound")).join(heard, ["key", "sound"])
    return slips.union(turned.select(name("k", "v").alias("x"), name("key", "value").alias("y")))


def linked(names: DataFrame) -> DataFrame:
    """(name, entity): strings of a column ``name`` that mean a particular person or organisation.

    Strings with the same ``entity`` mean the same one.  Bare given names, titles and forms that
    fit several entities have no rows.  Repeated strings count once; an empty table gives no rows.
    """
    distinct = materialise(names.filter("name is not null").select("name").distinct())
    parsed = materialise(_parsed(distinct, KINDS | learned_kinds(distinct)))
    entity = F.concat_ws("|", "kind", "key", "value")
    full = parsed.filter("form = 'full'").select("name", "kind", "key", F.col("fits")[0].alias("value"))
    entities = materialise(full.select("kind", "key", "value").distinct())
    # In a name of three letters, and in a number, one edit makes another name.
    pairs = materialise(pairs_within_one(parsed.filter(f"length(key) >= {SLIP_LETTERS} and not key rlike '[0-9]'").select("key").distinct(), "key"))
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # The same given name, or kind, with surnames one edit apart.
    other = entities.select("kind", F.col("key").alias("b"), "value")
    slips = entities.withColumnRenamed("key", "a").join(pairs, "a").join(other, ["kind", "b", "value"]).select(F.concat_ws("|", "kind", "a", "value").alias("x"), F.concat_ws("|", "kind", "b", "value").alias("y"))
    joined = connected_components(slips.union(_unknown_given(entities)).union(_short_links(entities, both)), "x", "y").select(F.col("node").alias("entity"), "component")
    # Forms that leave something out: with their own surname, else with one an edit away.
    loose = parsed.filter("form != 'full'").select("name", "kind", "key", "form", "fits")
    same = loose.join(entities.withColumn("own", F.lit(True)), ["kind", "key"])
    known = entities.select("kind", "key").distinct()
    away = loose.join(known, ["kind", "key"], "left_anti").join(both, F.col("key") == F.col("a")).drop("key", "a").withColumnRenamed("b", "key").join(entities, ["kind", "key"]).withColumn("own", F.lit(False))
    letters = F.array_join(F.array_sort(F.transform(F.split("value", " "), lambda w: F.substring(w, 1, 1))), "")
    fits = (
        F.when(F.col("form") == "some", F.array_contains("fits", F.col("value")))
        .when(F.col("form") == "initial", F.expr("startswith(value, fits[0])"))
        .when(F.col("form") == "part", F.forall(F.split(F.col("fits")[0], " "), lambda w: (w == "") | F.array_contains(F.split("value", " "), w)))
        .when(F.col("form") == "acronym", letters == F.col("fits")[0])
        .otherwise(F.col("form") == "title")
    )
    columns = ["name", "kind", "key", "value"]
    fitting = same.filter(fits).select(*columns).unionByName(away.filter(fits).select(*columns)).withColumn("entity", entity).join(joined, "entity", "left").select("name", F.coalesce("component", "entity").alias("entity"))
    one = fitting.groupBy("name").agg(F.min("entity").alias("entity"), F.max("entity").alias("last")).filter("entity = last").drop("last")
    # Forms that fit no entity are one with others of just the same form.
    alone = loose.filter("form in ('initial', 'acronym', 'some', 'part')").join(fitting.select("name").distinct(), "name", "left_anti").select("name", F.concat_ws("|", "kind", "key", "form", F.array_join("fits", "/")).alias("entity"))
    certain = full.withColumn("entity", entity).join(joined, "entity", "left").select("name", F.coalesce("component", "entity").alias("entity"))
    return certain.unionByName(one).unionByName(alone)


def name_pairs(links: DataFrame) -> DataFrame:
    """(name_a, name_b) with name_a < name_b in byte order: all pairs of an entity's spellings."""
    links = materialise(links)
    return links.select("entity", F.col("name").alias("name_a")).join(links.select("entity", F.col("name").alias("name_b")), "entity").filter("name_a < name_b").select("name_a", "name_b")
