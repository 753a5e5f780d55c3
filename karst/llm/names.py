"""Problem 1: spellings of names that mean the same person or organisation.

1.  Names are normalised and taken apart: given names and initials, the distinctive part
    (surname or firm name), the sector words, legal form and place of a firm. Which words
    are common (given names, sectors, places) is learned from how many records and
    namespaces use them; their misspellings and abbreviations are read as the common word.
2.  Distinct forms of a namespace stand for their records. Distinctive parts within two
    edits are found by a symmetric-delete index: two strings within k edits share a string
    that at most k deletions make of each.
3.  Forms with near distinctive parts are compared by the best assignment of their other
    tokens, where initials, abbreviations and pet names may stand for a name.
4.  Full forms that agree are joined into components. A form that leaves the person or
    firm open (an initial, a pet name of two names, a firm without its sector) joins none
    of them unless exactly one fits, so it never ties relatives or sister firms together.

All joins are on (namespace, distinctive part); components spread by joins with the
lineage cut each round. The learned common words are bounded by their least share of records.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.core.session import cut, staged

#: Pet names in Italian, English and Spanish, with the names they stand for.
PET_NAMES = {
    "ale": "alessandra alessandro", "alex": "alessandra alessandro alexander", "ali": "alice alessandra", "anto": "antonella antonio antonia",
    "baldo": "ubaldo", "bea": "beatrice", "beppe": "giuseppe", "bepi": "giuseppe", "betta": "elisabetta", "betty": "elisabetta elizabeth",
    "bill": "william", "billy": "william", "bob": "robert roberto", "bobby": "robert", "cate": "caterina", "cati": "caterina", "cath": "catherine katherine",
    "checco": "francesco", "chiara": "chiara", "ciccio": "francesco", "cecco": "francesco", "dom": "domenico", "edo": "edoardo", "ele": "eleonora elena",
    "eli": "elisabetta elisa", "fede": "federico federica", "fra": "francesco francesca", "franco": "francesco", "frank": "francesco", "gabri": "gabriele gabriella",
    "gigi": "luigi", "gino": "luigi", "gio": "giovanni giorgio", "gianni": "giovanni", "giusi": "giuseppina", "giuse": "giuseppe", "jon": "jonathan", "jonny": "jonathan",
    "johnny": "jonathan john", "joni": "jonathan", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "lele": "raffaele gabriele",
    "lella": "antonella raffaella", "lisa": "elisabetta", "liz": "elizabeth elisabetta", "marghe": "margherita", "mimmo": "domenico", "mico": "domenico",
    "nacha": "ignacia", "nachita": "ignacia", "nacho": "ignacio", "nando": "hernando ferdinando", "nella": "antonella", "niccolo": "niccolo", "nico": "niccolo domenico nicola",
    "nicola": "nicola", "nino": "antonio", "ottavia": "ottavia", "paco": "francisco francesco", "pancho": "francisco", "peppe": "giuseppe", "peppino": "giuseppe",
    "pen": "penelope", "penny": "penelope", "pepe": "jose giuseppe", "pippo": "filippo giuseppe", "raf": "raffaele", "raffa": "raffaele raffaella", "rina": "caterina",
    "rita": "margherita", "rob": "robert roberto", "robbie": "robert", "robby": "robert", "sal": "salvatore", "salvo": "salvatore", "sandra": "alessandra", "sandro": "alessandro",
    "stef": "stefano", "stefo": "stefano", "steve": "stefano stephen", "tavia": "ottavia", "tina": "valentina caterina", "titti": "caterina", "tonia": "antonella antonia",
    "toto": "salvatore", "totò": "salvatore", "turi": "salvatore", "ubi": "ubaldo", "vale": "valentina valerio valeria", "val": "valentina", "will": "william",
    "willy": "william", "yoli": "yolanda", "yola": "yolanda", "yoly": "yolanda", "zac": "zacharias", "zack": "zacharias", "zach": "zacharias", "zak": "zacharias",
    "pino": "giuseppe", "ste": "stefano", "nicco": "niccolo", "lello": "raffaele", "tore": "salvatore", "cesco": "francesco", "chicco": "francesco", "franci": "francesca francesco",
    "rafa": "raffaele", "tony": "antonio antonella", "toni": "antonio antonella", "caty": "caterina", "trina": "caterina", "greta": "margherita", "marga": "margherita", "meg": "margherita",
    "maggie": "margherita", "gigino": "luigi", "luigino": "luigi", "luis": "luigi", "igna": "ignacia", "yoyi": "yolanda", "yol": "yolanda", "sandy": "alessandra", "kitty": "katherine",
    "willie": "william", "johny": "jonathan", "nate": "jonathan", "peppo": "giuseppe", "beppino": "giuseppe", "mingo": "domenico", "menico": "domenico", "elisa": "elisabetta elisa",
}
#: Titles and roles written beside a person's name.
TITLES = set("dott dottssa dottoressa dr dra avv ing arch geom rag prof profssa sig sigra signor signora mr mrs ms don dona donna sr sra cav on egr spett".split())
#: Legal forms with their spellings, longest first when sought.
LEGAL = {
    "spa": ["societa per azioni", "s p a", "spa"], "srl": ["societa a responsabilita limitata", "soc a resp limitata", "soc a resp lim", "s r l", "srl"],
    "snc": ["societa in nome collettivo", "s n c", "snc"], "sas": ["societa in accomandita semplice", "s a s", "sas"],
    "coop": ["societa cooperativa a responsabilita limitata", "societa cooperativa", "soc coop a r l", "soc coop", "soccoop", "s c a r l", "scarl", "scrl"],
    "ltd": ["limited", "ltd"], "plc": ["plc"], "inc": ["incorporated", "inc"], "sl": ["sociedad limitada", "s l u", "slu"], "sa": ["sociedad anonima"],
}
_LEGAL = re.compile(r"\b(?:" + "|".join(s for _, s in sorted(((f, s) for f, x in LEGAL.items() for s in x), key=lambda p: -len(p[1]))) + r")\b")
_FORM = {s: f for f, x in LEGAL.items() for s in x}
#: Letters of other alphabets that look Latin.
_ALIKE = str.maketrans("аеорсхуікмтнвАЕОРСХУІКМТНВαορν’`´", "aeopcxyikmthbaeopcxyikmthbaopv'''")
_JOIN = {"di", "de", "del", "della", "dei", "degli", "e", "and", "of", "y", "the", "il", "la"}


@dataclass(frozen=True)
class Params:
    common_share: float = 0.002  # of all records, for a common word
    common_least: int = 5
    common_spaces: int = 4
    pet_names: Mapping[str, str] = field(default_factory=lambda: PET_NAMES)  # a resource that may be empty: pet name -> names


def fold(text: str) -> str:
    """Lower case, no accents, look-alike letters as Latin, single blanks."""
    s = unicodedata.normalize("NFKD", text.translate(_ALIKE)).lower()
    return " ".join("".join(c for c in s if not unicodedata.combining(c)).split())


def tokens(text: str) -> tuple[list[str], str, list[str], bool]:
    """(words, legal form, parts set off in brackets or behind a dash, whether it is a date or amount: digits or a
    currency sign without a legal form)."""
    s = fold(text)
    amount = bool(re.search(r"[\d€$£]", s)) and not _LEGAL.search(re.sub(r"[^\w]+", " ", re.sub(r"(?<=\w)\.(?=\w)", "", s)))  # a firm's name may have a number
    aside = re.findall(r"\(([^)]*)\)?", s)
    s = re.sub(r"\([^)]*\)?", " ", s)
    s, dash, behind = s.partition(" - ")
    if dash:
        aside.append(behind)
    s = re.sub(r"(?<=\w)['’\-.](?=\w)", "", s)  # marks within a word, the points of an abbreviation too
    s = " ".join(re.sub(r"[^\w]+", " ", s).split())
    legal = ""
    while m := _LEGAL.search(s):
        legal = legal or _FORM[m[0]]
        s = " ".join((s[: m.start()] + " " + s[m.end() :]).split())
    return s.split(), legal, [re.sub(r"[^\w ]+", "", x).strip() for x in aside], amount


def edits(a: str, b: str, most: int) -> int:
    """Edits between two strings, a swap of neighbours counting once; most + 1 beyond `most`."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def deletes(word: str, most: int) -> set[str]:
    """What at most `most` deletions leave of a word."""
    return {"".join(c for i, c in enumerate(word) if i not in gone) for k in range(most + 1) for gone in combinations(range(len(word)), k)}


def abbreviates(short: str, word: str) -> bool:
    """A prefix of two letters or more, or a contraction: same first and last letter, in order between."""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return False
    if word.startswith(short):
        return True
    it = iter(word)
    return len(short) >= 3 and short[-1] == word[-1] and all(c in it for c in short)


class Reader:
    """Takes names apart, with the learned common words: word -> given, sector or place."""

    def __init__(self, common: dict[str, str], pet_names: Mapping[str, str] = PET_NAMES):
        self.kind = dict(common)
        # of the names a pet name may stand for, those that the collection uses
        used = {w for w, k in common.items() if k == "given"}
        self.pets = {pet: frozenset(x & used or x) for pet, names in pet_names.items() for x in [{fold(n) for n in names.split()}]}
        self.known = set(common)
        for pet, names in pet_names.items():
            for w in (pet, *names.split()):
                self.kind.setdefault(fold(w), "given")
        sectors = [w for w, k in self.kind.items() if k == "sector"]
        # a common abbreviation is read as the sector word it stands for
        self.alias = {w: max(found, key=lambda s: (s.startswith(w), len(s), s)) for w in sectors if (found := [s for s in sectors if abbreviates(w, s)])}
        for w in self.alias:  # of an abbreviation of an abbreviation the word itself
            while self.alias[w] in self.alias:
                self.alias[w] = self.alias[self.alias[w]]
        # what one deletion leaves of a common word of five letters, two of one of seven
        self.index: dict[str, list[str]] = {}
        for w in self.kind:
            if len(w) >= 5:
                for x in deletes(w, 2 if len(w) >= 7 else 1):
                    self.index.setdefault(x, []).append(w)
        self.sectors = sorted(w for w in sectors if w not in self.alias)
        self.memo: dict[str, tuple[str, str]] = {}

    def read(self, word: str) -> tuple[str, str]:
        """(kind, common word) of a token; kind "" for a distinctive one."""
        if word not in self.memo:
            if len(self.memo) > 300_000:
                self.memo.clear()
            kind, common = self._read(word)
            self.memo[word] = (kind, self.alias.get(common, common))
        return self.memo[word]

    def _read(self, word: str) -> tuple[str, str]:
        if word in self.kind:
            return self.kind[word], word
        if len(word) == 1:
            return "initial", word
        if len(word) >= 4:
            near = sorted({w for x in deletes(word, 1) for w in self.index.get(x, []) if edits(word, w, 1) <= 1}, key=lambda w: (w not in self.known, w))
            if near:
                return self.kind[near[0]], near[0]
            if len(word) >= 7:
                near = sorted({w for x in deletes(word, 2) for w in self.index.get(x, []) if len(w) >= 7 and w[0] == word[0] and edits(word, w, 2) <= 2}, key=lambda w: (w not in self.known, w))
                if near:
                    return self.kind[near[0]], near[0]
        return "", word

    def names_of(self, given: str) -> frozenset[str]:
        """The names a given name or pet name may stand for."""
        return self.pets.get(given) or frozenset([given])

    def parse(self, name: str | None) -> dict | None:
        """kind, core, given (first name first), legal, place, sector of a name; None for what is no person or firm."""
        if not name or not name.strip():
            return None
        words, legal, aside, amount = tokens(name)
        if amount or not words:
            return None
        words = [w for w in words if w not in TITLES] or words
        place = ""
        for part in aside:
            if part and self.read(part.split()[0])[0] == "place":
                place = self.read(part.split()[0])[1]
        if len(words) > 2 and words[-2] in _JOIN and self.read(words[-1])[0] == "place":
            place = self.read(words[-1])[1]
            words = words[:-2]
        # an e or y at an end is an initial, between words a conjunction
        read = [(w, *self.read(w)) for i, w in enumerate(words) if w not in _JOIN or (len(w) == 1 and i in (0, len(words) - 1))]
        bare = len(read) == 1 and not read[0][1] and len(read[0][0]) > 4  # a distinctive word alone: a firm's short name, or nothing
        dotted = bool(re.search(r"\b(?:\w\.){2,}", fold(name))) and not any(k == "given" for _, k, _ in read)
        firm = bool(legal) or any(k == "sector" for _, k, _ in read) or bare or dotted
        if not firm:
            read = self._mended(read)
            given = [v for _, k, v in read if k in ("given", "initial")]
            core = "".join(w for w, k, _ in read if k not in ("given", "initial"))
            if len(core) < 2 or not given or len(read) < 2:
                return None
            return {"kind": "P", "core": core, "given": given, "legal": "", "place": "", "sector": []}
        sector, rest = [], []
        for w, k, v in read:
            if k == "sector":
                sector.append("~" + v if len(v) <= 4 else v)  # a common acronym stays one
            elif k == "place" and len(read) > 1 and not place and v == w and len(rest):
                place = v
            else:
                whole = self._abbreviation(w) if len(w) <= 8 and len(read) > 1 else None
                if whole:
                    sector.append(whole)
                else:
                    rest.append(w)
        long = [w for w in rest if len(w) > 4]
        if long and len(rest) > 1:  # short leftovers beside a long word are acronyms of the sector
            sector += ["~" + w for w in rest if len(w) <= 4 and rest.index(w) != rest.index(long[0]) and not self._splits(rest)]
            rest = rest if self._splits(rest) else long + [w for w in rest if len(w) > 4 and w not in long]
        core = "".join(rest)
        if len(core) < 2:
            return None
        return {"kind": "O", "core": core, "given": [], "legal": legal, "place": place, "sector": sorted(set(sector))}

    @staticmethod
    def _splits(rest: list[str]) -> bool:
        return len(rest) == 2 and min(map(len, rest)) == 4

    def _abbreviation(self, word: str) -> str | None:
        found = [s for s in self.sectors if abbreviates(word, s)]
        if len(word) == 2:  # two letters may as well be an acronym: only for the one word of the collection that fits
            found = [s for s in found if s in self.known]
            return found[0] if len(found) == 1 else None
        return min(found, key=lambda s: (not s.startswith(word), s)) if found else None

    def _mended(self, read: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
        """Given names broken in two are joined again."""
        out, i = [], 0
        while i < len(read):
            if i + 1 < len(read) and read[i][1] == read[i + 1][1] == "" and len(read) > 2:
                both = read[i][0] + read[i + 1][0]
                kind, v = self.kind.get(both, ""), both
                if kind == "given":
                    out.append((both, kind, v))
                    i += 2
                    continue
            out.append(read[i])
            i += 1
        return out

    def open_form(self, f: dict) -> bool:
        """Whether the form leaves open whom it means."""
        if f["kind"] == "P":
            first = f["given"][0]
            return len(first) == 1 or len(self.names_of(first)) > 1
        return not f["sector"]

    def same(self, a: dict, b: dict) -> bool:
        """Whether two forms may mean the same, given that their cores are near."""
        if a["kind"] != b["kind"]:
            return False
        d = edits(a["core"], b["core"], 2)
        if d > (2 if min(len(a["core"]), len(b["core"])) >= 8 else 1 if min(len(a["core"]), len(b["core"])) >= 4 else 0):
            return False
        if a["kind"] == "P":
            if d == 2 and (self.open_form(a) or self.open_form(b)):
                return False
            return self._given(a["given"], b["given"])
        if a["legal"] and b["legal"] and a["legal"] != b["legal"]:
            return False
        if a["place"] and b["place"] and a["place"] != b["place"]:
            return False
        if not a["sector"] or not b["sector"]:
            return d < 2
        return self._sector(a["sector"], b["sector"])

    def _stands(self, x: str, y: str) -> bool:
        """Whether two given names, pet names or initials may be one."""
        if len(x) == 1 or len(y) == 1:
            if len(x) > len(y):
                x, y = y, x
            return y[0] == x or any(n[0] == x for n in self.names_of(y))
        return bool(self.names_of(x) & self.names_of(y))

    def _given(self, a: list[str], b: list[str]) -> bool:
        """Best assignment of the given names: the first to the first, the others of the shorter list all to one each."""
        if not self._stands(a[0], b[0]):
            return False
        short, long = sorted((a[1:], b[1:]), key=len)
        taken: dict[int, int] = {}  # place in `long` -> place in `short`

        def place(i: int, tried: set[int]) -> bool:
            """Finds a partner for the i-th name, moving others to another of theirs where needed."""
            for j, y in enumerate(long):
                if j not in tried and self._stands(short[i], y):
                    tried.add(j)
                    if j not in taken or place(taken[j], tried):
                        taken[j] = i
                        return True
            return False

        return all(place(i, set()) for i in range(len(short)))

    def firsts(self, f: dict) -> list[str]:
        """Initials that the first name may have, of which forms of one person share one; one for all firms."""
        if f["kind"] != "P":
            return [""]
        first = f["given"][0]
        return sorted({first[0], *(n[0] for n in self.names_of(first))})

    def _sector(self, a: list[str], b: list[str]) -> bool:
        plain_a, plain_b = ([s for s in x if s[0] != "~"] for x in (a, b))
        if plain_a and plain_b:
            return set(plain_a) <= set(plain_b) or set(plain_b) <= set(plain_a)
        short, long = (a, plain_b) if plain_b else (b, plain_a)
        letters = {"".join(sorted(w[0] for w in long))} - {""}  # in any order
        acronyms = {s[1:] for s in short} | {re.sub(r"(.)\1", r"\1", s[1:]) for s in short}
        return bool(letters & {"".join(sorted(x)) for x in acronyms}) or any(abbreviates(x, w) for x in acronyms for w in long) or not long and a == b


def spellings(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, namespace, name, place: one row for each distinct name of a record, aliases left out.

    Rows without key, namespace or name are left out; extra columns are not read.
    """
    a = entities.select(F.col("entity_id").alias("key"), "namespace", F.col("entity_name").alias("name"), F.lit(None).cast("string").alias("city"))
    props = F.col("properties")
    b = nodes.select(F.col("id").alias("key"), "namespace", F.try_element_at(props, F.lit("name")).alias("name"), F.try_element_at(props, F.lit("city")).alias("city"))
    return a.unionByName(b).where("key is not null and namespace is not null and name is not null").distinct()


def learn(names: DataFrame, p: Params) -> dict[str, str]:
    """The common words of all names and what they are, by their use in the whole collection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for space, name, city in zip(*(c.to_pylist() for c in batch.columns)):
                words, legal, aside, amount = tokens(name)
                if amount:
                    continue
                single = len(words) == 1 and not legal
                for w in {x for x in words if len(x) > 2 and x not in _JOIN and x not in TITLES}:
                    out.append((w, space, 1, int(bool(legal)), int(single)))
                for w in {y for x in [*aside, fold(city or "")] for y in x.split() if len(y) > 3}:
                    out.append((w, space, 0, 0, 1))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["word", "space", "n", "firms", "places"]
            )

    rows = names.select("namespace", "name", "city").mapInArrow(run, "word string, space string, n bigint, firms bigint, places bigint")
    per_space = rows.groupBy("word", "space").agg(*(F.sum(c).alias(c) for c in ("n", "firms", "places")))
    total = names.count()
    # bounded: a record has few words, and a common word is in `common_share` of all records
    least = max(p.common_least, p.common_share * total)
    words = per_space.groupBy("word").agg(F.count("*").alias("spaces"), *(F.sum(c).alias(c) for c in ("n", "firms", "places")))
    found = words.where((F.col("n") + F.col("places") >= least) & (F.col("spaces") >= p.common_spaces)).toPandas()
    kinds = {}
    for r in found.itertuples():
        if r.places >= 3 and r.places > 0.5 * r.n:
            kinds[r.word] = "place"
        elif r.firms >= 0.25 * r.n:
            kinds[r.word] = "sector"
        else:
            kinds[r.word] = "given"
    return kinds


FORMS = "namespace string, key string, form string, kind string, core string, given array<string>, legal string, place string, sector array<string>, open boolean, firsts array<string>"


def read_forms(names: DataFrame, common: dict[str, str], pets: Mapping[str, str] = PET_NAMES) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(common, pets)
        texts = pa.list_(pa.string())
        types = [pa.string()] * 5 + [texts, pa.string(), pa.string(), texts, pa.bool_(), texts]
        for batch in batches:
            out: list[tuple] = []
            for key, space, name in zip(*(c.to_pylist() for c in batch.columns)):
                f = reader.parse(name)
                if f:
                    form = "|".join([f["kind"], f["core"], " ".join(f["given"]), f["legal"], f["place"], " ".join(f["sector"])])
                    out.append((space, key, form, f["kind"], f["core"], f["given"], f["legal"], f["place"], f["sector"], reader.open_form(f), reader.firsts(f)))
            cols = list(zip(*out)) if out else [()] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in FORMS.split(", ")])

    return names.select("key", "namespace", "name").mapInArrow(run, FORMS)


def thirds(core: str) -> dict[str, bool]:
    """Keys that two cores within two edits share; true for the core's own thirds.

    Two edits leave one of three parts of a core whole, moved by two places at most. So a core also
    gives the parts that cores of nearly its length would have there.
    """
    out: dict[str, bool] = {}
    for n in range(len(core) - 2, len(core) + 3):
        for i in range(3):
            start, end = n * i // 3, n * (i + 1) // 3
            for move in range(-2, 3):
                if start + move >= 0 and end + move <= len(core):
                    key = f"\x00{n} {i} {core[start + move : end + move]}"
                    out[key] = out.get(key, False) or (n == len(core) and move == 0)
    return out


def near_cores(forms: DataFrame) -> DataFrame:
    """namespace, kind, a, b: distinct cores that may be within two edits (one for short cores), by
    symmetric deletes, long ones by equal thirds; a <= b."""
    spark = forms.sparkSession
    cores = forms.select("namespace", "kind", "core").distinct()
    # few rows make many: as many tasks as the session's shuffles have, which adaptive execution would merge for so small an input
    cores = cores.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "core")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for space, kind, core in zip(*(c.to_pylist() for c in batch.columns)):
                if len(core) <= 24:
                    out += [(space, kind, core, x, True) for x in deletes(core, 2 if len(core) >= 8 else 1)]
                if len(core) >= 23:  # those of 23 and 24 meet both kinds of partners
                    out += [(space, kind, core, x, own) for x, own in thirds(core).items()]
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 4 + [pa.bool_()])], ["namespace", "kind", "core", "left", "own"])

    index = cores.mapInArrow(run, "namespace string, kind string, core string, left string, own boolean").select("namespace", "kind", "core", F.xxhash64("left").alias("h"), "own")
    index = staged(index)
    a, b = index.alias("a"), index.alias("b")
    pairs = a.join(b, F.expr("a.namespace = b.namespace and a.kind = b.kind and a.h = b.h and a.core < b.core and (a.own or b.own)"))
    pairs = pairs.select("a.namespace", "a.kind", F.col("a.core").alias("a"), F.col("b.core").alias("b")).distinct()
    return pairs.unionByName(cores.select("namespace", "kind", F.col("core").alias("a"), F.col("core").alias("b")))


def form_links(forms: DataFrame, common: dict[str, str], pets: Mapping[str, str] = PET_NAMES) -> DataFrame:
    """namespace, x, y, x_open, y_open: forms that may mean the same; full forms first, x <> y."""
    near = near_cores(forms)
    cols = ["form", "kind", "core", "given", "legal", "place", "sector", "open"]
    # forms of one core meet by the initial of the first name, so the many bearers of a common surname are parted
    sides = forms.select("namespace", "kind", "core", F.explode("firsts").alias("first"), F.struct(*cols).alias("form"))
    left = sides.withColumnsRenamed({"core": "a", "form": "x"})
    right = sides.withColumnsRenamed({"core": "b", "form": "y"})
    pairs = near.join(left, ["namespace", "kind", "a"]).join(right, ["namespace", "kind", "b", "first"]).select("namespace", "x", "y")
    pairs = pairs.where("x.form <> y.form and (x.core <> y.core or x.form < y.form)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(common, pets)
        for batch in batches:
            out = [(s, x["form"], y["form"], x["open"], y["open"]) for s, x, y in zip(*(c.to_pylist() for c in batch.columns)) if reader.same(x, y)]
            cols_ = list(zip(*out)) if out else [()] * 5
            kinds = [pa.string()] * 3 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols_, kinds)], ["namespace", "x", "y", "x_open", "y_open"])

    return pairs.mapInArrow(run, "namespace string, x string, y string, x_open boolean, y_open boolean").distinct()


def components(forms: DataFrame, links: DataFrame) -> DataFrame:
    """namespace, form, root: the least form that each full form reaches, spread by joins until nothing changes."""
    ways = staged(links.select("namespace", F.col("x").alias("form"), F.col("y").alias("to")).unionByName(links.select("namespace", F.col("y").alias("form"), F.col("x").alias("to"))))
    roots = cut(forms.select("namespace", "form", F.col("form").alias("root")))
    while True:
        told = ways.join(roots.select("namespace", F.col("form").alias("to"), "root"), ["namespace", "to"]).groupBy("namespace", "form").agg(F.min("root").alias("heard"))
        step = roots.join(told, ["namespace", "form"], "left").withColumn("next", F.least("root", "heard"))
        # the root's own root: paths halve each round
        up = step.select("namespace", F.col("form").alias("next"), F.col("next").alias("beyond"))
        step = cut(step.select("namespace", "form", "root", "next").join(up, ["namespace", "next"]).select("namespace", "form", "root", F.least("next", "beyond").alias("new")))
        changed = step.where("new <> root").limit(1).count()
        roots = step.select("namespace", "form", F.col("new").alias("root"))
        if not changed:
            return roots


def same_names(entities: DataFrame, nodes: DataFrame, p: Params = Params()) -> DataFrame:
    """namespace, key, root: each record that names a person or organisation, with the root of those meaning the same.

    Places, dates, amounts and unreadable names have no row. Repeated rows count once. A
    node's name decides, not its alias.
    """
    names = staged(spellings(entities, nodes))
    common = learn(names, p)
    records = staged(read_forms(names, common, p.pet_names).dropDuplicates(["namespace", "key", "form"]))
    forms = staged(records.select("namespace", "form", "kind", "core", "given", "legal", "place", "sector", "open", "firsts").dropDuplicates(["namespace", "form"]))
    links = staged(form_links(forms, common, p.pet_names))
    full = components(forms.where("not open").select("namespace", "form"), links.where("not x_open and not y_open"))
    # an open form takes the one component that it may mean
    ends = links.where("x_open and not y_open").select("namespace", F.col("x").alias("form"), F.col("y").alias("to"))
    ends = ends.unionByName(links.where("y_open and not x_open").select("namespace", F.col("y").alias("form"), F.col("x").alias("to")))
    reached = ends.join(full.select("namespace", F.col("form").alias("to"), "root"), ["namespace", "to"]).groupBy("namespace", "form")
    one = reached.agg(F.min("root").alias("root"), F.max("root").alias("other"))
    # open forms that no full one explains stand for each other if their cores are one
    # (a single word that no firm explains may as well be a place)
    alone = forms.where("open and (kind = 'P' or legal <> '')").join(one.select("namespace", "form"), ["namespace", "form"], "left_anti")
    first = F.when(F.col("kind") == "P", F.substring(F.element_at("given", 1), 1, 1)).otherwise(F.concat_ws("/", "legal", "place"))
    alone = alone.withColumn("first", first)
    group = ["namespace", "kind", "core", "first"]
    alone = alone.join(alone.groupBy(*group).agg(F.concat(F.lit("~"), F.min("form")).alias("root")), group).select("namespace", "form", "root")
    # with several to choose from it stands for itself
    chosen = one.select("namespace", "form", F.when(F.col("root") == F.col("other"), F.col("root")).otherwise(F.concat(F.lit("~"), F.col("form"))).alias("root"))
    roots = full.unionByName(chosen).unionByName(alone)
    return records.select("namespace", "key", "form").join(roots, ["namespace", "form"]).select("namespace", "key", "root").distinct()


def pairs_of(records: DataFrame) -> DataFrame:
    """key_a < key_b of the records with a common root: what p1_found asks for, of the size of its result."""
    a, b = records.alias("a"), records.alias("b")
    pairs = a.join(b, F.expr("a.namespace = b.namespace and a.root = b.root and a.key < b.key"))
    return pairs.select(F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b")).distinct()
