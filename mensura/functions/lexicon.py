"""The term table: entity forms, their canonical term and type, and patterns made from it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of the elements by symbol, with further forms where there are any.
ELEMENTS = {
    "La": ["lanthanum", "lanthane"], "Ce": ["cerium"], "Pr": ["praseodymium"], "Nd": ["neodymium"], "Pm": ["promethium"], "Sm": ["samarium"], "Eu": ["europium"], "Gd": ["gadolinium"], "Tb": ["terbium"],
    "Dy": ["dysprosium"], "Ho": ["holmium"], "Er": ["erbium"], "Tm": ["thulium"], "Yb": ["ytterbium"], "Lu": ["lutetium", "lutecium"], "Y": ["yttrium"], "Sc": ["scandium"],
}
#: Groups, oxides, minerals and materials with the forms they are written in.
GROUPS = {
    "REE": ["rare earth elements", "rare earth element", "rare-earth element", "rare earths", "rare-earths", "rare earth", "rare-earth", "rare‐earth", "rare‑earth", "rare‐earth element", "rare‑earth element", "REEs", "lanthanide", "lanthanides", "lanthanoid", "lanthanoids"],
    "LREE": ["light rare earth elements", "light rare earth", "light REE", "LREEs", "light rare-earth"],
    "HREE": ["heavy rare earth elements", "heavy rare earth", "heavy REE", "HREEs", "heavy rare-earth"],
    "MREE": ["medium rare earth elements", "middle rare earth", "medium rare earth", "MREEs"],
    "TREE": ["total rare earth elements", "total rare earth element", "total REE", "total REEs", "TREEs", "ΣREE", "∑REE", "sum of REE"],
    "REY": ["rare earth elements and yttrium", "REYs", "REE+Y", "REE + Y", "rare-earth elements and yttrium"],
}
OXIDES = {
    "TREO": ["total rare earth oxide", "total REO", "ΣREO", "∑REO", "REE2O3", "ΣREE2O3", "∑REE2O3"], "REO": ["rare earth oxide", "REOs"],
    "La2O3": ["lanthanum oxide", "La₂O₃"], "CeO2": ["cerium dioxide", "CeO₂", "ceria"], "Pr6O11": ["praseodymium oxide", "Pr₆O₁₁"], "Nd2O3": ["neodymium oxide", "Nd₂O₃"],
    "Sm2O3": ["samarium oxide", "Sm₂O₃"], "Eu2O3": ["europium oxide", "Eu₂O₃"], "Gd2O3": ["gadolinium oxide", "Gd₂O₃"], "Tb4O7": ["terbium oxide", "Tb₄O₇"], "Dy2O3": ["dysprosium oxide", "Dy₂O₃"],
    "Y2O3": ["yttrium oxide", "Y₂O₃", "yttria"], "Sc2O3": ["scandium oxide", "Sc₂O₃", "scandia"], "ThO2": ["thorium dioxide", "ThO₂", "thoria"], "U3O8": ["triuranium octoxide", "U₃O₈"],
}
MINERALS = {
    "bastnasite": ["bastnaesite", "bastnäsite", "bastnaesita"], "monazite": ["monazita"], "xenotime": ["xenotima"], "allanite": ["allanita"], "eudialyte": ["eudialite"], "loparite": [],
    "apatite": ["fluorapatite"], "zircon": [], "parisite": [], "synchysite": [], "fergusonite": [], "gadolinite": [],
}
MATERIALS = {
    "ion_adsorption_clay": ["ion-adsorption clay", "ion adsorption clay", "ionic clay", "weathered crust elution-deposited"], "carbonatite": [], "laterite": ["lateritic"], "tailings": ["tailing"],
    "red_mud": ["red mud", "bauxite residue"], "coal_ash": ["coal ash", "fly ash", "coal fly ash", "coal combustion residue"], "phosphogypsum": ["phosphate rock"],
    "magnet_scrap": ["permanent magnet scrap", "magnet scrap", "NdFeB", "permanent magnet", "spent magnet"], "e_waste": ["electronic waste", "e-waste", "WEEE"],
}
#: Forms that only count in capitals, process terms, and phrases of another field.
CASE_SENSITIVE = ("REE", "REEs", "TREO", "TREE", "REO", "LREE", "HREE", "MREE", "REY", *ELEMENTS)
PROCESS_TERMS = ("recovery", "leaching", "leachability", "extraction efficiency", "selectivity", "separation factor", "desorption", "adsorption capacity", "beneficiation", "flotation", "roasting")
HOMONYMS = ("resting energy expenditure", "energy expenditure", "basal metabolic rate", "indirect calorimetry")

FORM = "form string, canonical string, entity_type string, case_sensitive boolean, spelling string"
#: Least similarity, in percent, of a fuzzy match, and least length of what is matched.
LEAST_RATIO, LEAST_LENGTH = 90.0, 4


def default_terms() -> list[tuple[str, str, str, bool, str]]:
    """(lower-cased form, canonical term, type, case-sensitive, spelling) of every form, first wins."""
    sections = (("element", ELEMENTS), ("element_group", GROUPS), ("oxide", OXIDES), ("mineral", MINERALS), ("other", MATERIALS))
    out: dict[str, tuple[str, str, str, bool, str]] = {}
    for kind, terms in sections:
        for canonical, forms in terms.items():
            for form in (canonical, *forms):
                out.setdefault(form.lower(), (form.lower(), canonical, kind, form in CASE_SENSITIVE, form))
    return list(out.values())


def yaml_terms(content: str) -> list[tuple[str, str, str, bool, str]]:
    """Terms of a YAML lexicon: sections with entity_type and termos (canonico, nome, variantes), and sensivel_a_caixa."""
    import yaml

    raw = yaml.safe_load(content)
    capitals = set(raw.get("sensivel_a_caixa", []))
    out = {}
    for section in raw.values():
        if isinstance(section, dict) and "entity_type" in section:
            for term in section["termos"]:
                for form in filter(None, [term["canonico"], term.get("nome"), *term.get("variantes", [])]):
                    out.setdefault(form.lower(), (form.lower(), term["canonico"], section["entity_type"], form in capitals, form))
    return list(out.values())


def load_lexicon(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The term table, our own or that of a YAML file (a few hundred rows, read by Spark from any store)."""
    terms = yaml_terms(spark.read.text(path, wholetext=True).first()[0]) if path else default_terms()
    columns = [f.name for f in T._parse_datatype_string(FORM).fields]
    # an Arrow table becomes a local relation, whose size the optimizer knows
    return spark.createDataFrame(pa.table(dict(zip(columns, zip(*terms)))), FORM)


# ---- patterns ------------------------------------------------------------------------------

_WORD = r"\p{L}\p{N}_"


def _bounded(form: str) -> str:
    """A form between word boundaries that know Unicode digits and letters."""
    first = rf"(?<![{_WORD}])" if re.match(r"\w", form[0]) else rf"(?<=[{_WORD}])"
    last = rf"(?![{_WORD}])" if re.match(r"\w", form[-1]) else rf"(?=[{_WORD}])"
    return first + "\\Q" + form + "\\E" + last


def term_pattern(terms: list[tuple[str, str, str, bool, str]] | None = None) -> str:
    """Any form of the lexicon, longest first; capitals only where the form asks for them."""
    terms = default_terms() if terms is None else terms
    order = sorted({(t[4], t[3]) for t in terms}, key=lambda t: (-len(t[0]), t[0]))
    free, strict = ["|".join(_bounded(f) for f, capitals in order if capitals == kind) for kind in (False, True)]
    return "|".join(x for x in (f"(?iu:{free})" if free else "", f"(?:{strict})" if strict else "") if x)


def process_pattern(terms: tuple[str, ...] = PROCESS_TERMS) -> str:
    """Any process term, as the beginning of a word or words."""
    return rf"(?i)(?<![{_WORD}])(?:" + "|".join(re.escape(t).replace("\\ ", " ") for t in sorted(terms, key=len, reverse=True)) + ")"


def terms_in(text: Column, pattern: str | None = None) -> Column:
    """The lexicon's forms in a text, in order, without overlaps."""
    return F.regexp_extract_all(text, F.lit(pattern or term_pattern()), F.lit(0))


def has_term(text: Column, pattern: str | None = None) -> Column:
    return F.coalesce(text.rlike(pattern or term_pattern()), F.lit(False))


def has_process(text: Column) -> Column:
    return F.coalesce(text.rlike(process_pattern()), F.lit(False))


def homonym_flag(text: Column, phrases: tuple[str, ...] = HOMONYMS) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(phrases)), F.lit(False))


def folded(text: str) -> str:
    """A text with each letter that has single-letter cases in one of them; positions stay."""
    return text.lower() if text.isascii() else "".join(map(_fold, text))


def _fold(c: str) -> str:
    up = c.upper()
    low = (up if len(up) == 1 else c).lower()
    return low if len(low) == 1 else c


class TermAutomaton:
    """Finds a lexicon's forms in a text in one pass over it, however many forms there are.

    Equal to ``term_pattern``: leftmost first, at one place forms of any case before those in
    capitals and longer ones before shorter, between the same boundaries, without overlaps.
    """

    def __init__(self, terms: Iterable[tuple[str, str, str, bool, str]]):
        import ahocorasick

        self.automata = []
        forms = {(t[4], t[3]) for t in terms}
        for strict in (False, True):
            own = ahocorasick.Automaton()
            for form, capitals in forms:
                if capitals == strict and form:
                    edges = tuple(bool(re.match(r"\w", c)) for c in (form[0], form[-1]))
                    own.add_word(form if strict else folded(form), (len(form), edges))
            own.make_automaton()
            self.automata.append(own if len(own) else None)

    @staticmethod
    def _word(text: str, at: int) -> bool:
        return 0 <= at < len(text) and (text[at].isalpha() or text[at].isnumeric() or text[at] == "_")

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = []
        for strict, (own, read) in enumerate(zip(self.automata, (folded(text), text))):
            for end, (n, (first, last)) in own.iter(read) if own else ():
                start = end - n + 1
                # beside a word character none may stand, beside another one must
                if self._word(text, start - 1) != first and self._word(text, end + 1) != last:
                    found.append((start, strict, -n))
        out, at = [], 0
        for start, _, n in sorted(found):
            if start >= at:
                at = start - n
                out.append((start, at))
        return out


def lexicon_terms(text: Column, terms: list[tuple[str, str, str, bool, str]]) -> Column:
    """``terms_in`` for a lexicon of many thousand forms: an Arrow function with one automaton for each worker.

    The forms are shipped to the tasks, some hundred bytes each in a worker's memory.
    """
    forms = [(None, None, None, t[3], t[4]) for t in terms]
    kept: list[TermAutomaton] = []

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        if not kept:
            kept.append(TermAutomaton(forms))
        return pd.Series([[t[a:b] for a, b in kept[0].spans(t)] if t is not None else None for t in texts], dtype=object)

    return find(text)


# ---- entity lookup -------------------------------------------------------------------------


def indel_ratio(a: str, b: str) -> float:
    """200 * longest common subsequence / summed length, the subsequence bit-parallel: one addition a letter."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full  # a zero bit for each letter of a that the subsequence has
    for c in b:
        hit = free & places.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return 200.0 * (len(a) - free.bit_count()) / (len(a) + len(b))


def _cuts(n: int) -> list[tuple[int, int]]:
    """Segments of a form of n letters, one more than a name within the ratio can differ from it by.

    Names of up to 11/9 of its length can reach 90; they and the form then differ by at most a
    tenth of both lengths in inserted and deleted letters, each of which spoils one segment.
    """
    k = min(n, (n + 11 * n // 9) // 10 + 1)
    return [(i * n // k, (i + 1) * n // k) for i in range(k)]


def _segment_rows(frames: Iterator[pd.DataFrame], keys: Callable[[str], Iterable[tuple[int, int, str]]]) -> Iterator[pd.DataFrame]:
    """A row (length, part, segment) for each key of each row's ``text``."""
    for frame in frames:
        found = [list(keys(t)) for t in frame["text"]]
        out = frame.loc[frame.index.repeat([len(f) for f in found])].reset_index(drop=True)
        flat = [x for f in found for x in f]
        yield out.assign(length=[x[0] for x in flat], part=[x[1] for x in flat], segment=[x[2] for x in flat])


def _form_keys(text: str) -> Iterator[tuple[int, int, str]]:
    for i, (a, b) in enumerate(_cuts(len(text))):
        yield len(text), i, text[a:b]


def _name_keys(text: str) -> Iterator[tuple[int, int, str]]:
    """Where the segments of forms of every length that can reach the ratio may stand in a name."""
    n = len(text)
    for length in range(-(-9 * n // 11), 11 * n // 9 + 1):
        most = (n + length) // 10
        for i, (a, b) in enumerate(_cuts(length)):
            yield from {(length, i, text[s : s + b - a]) for s in range(max(0, a - most), min(n - b + a, a + most) + 1)}


def fuzzy_lexicon(entities: DataFrame, lexicon: DataFrame, column: str = "entity") -> DataFrame:
    """(entity, form) of the first best form with a ratio of 90 and more, for the distinct entities.

    Forms are cut in segments, of which one at least stands unchanged, and near its place, in every
    name that reaches the ratio. An equi-join on the segments finds the candidates, whatever the
    number of forms, and only they are compared. Names under four letters are left out; equally
    good forms go by their place in the lexicon.
    """
    texts = lexicon.select(F.col("form").alias("text")).where("text IS NOT NULL").withColumn("place", F.monotonically_increasing_id())
    names = entities.select(F.col(column).alias("name")).where("name IS NOT NULL").distinct().withColumn("text", F.lower(F.regexp_replace("name", r"(?U)^\s+|\s+$", ""))).where(F.length("text") >= LEAST_LENGTH)

    def cut_forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _segment_rows(frames, _form_keys)

    def cut_names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _segment_rows(frames, _name_keys)

    of_forms = texts.mapInPandas(cut_forms, "text string, place bigint, length int, part int, segment string")
    of_names = names.mapInPandas(cut_names, "name string, text string, length int, part int, segment string")
    met = of_names.withColumnRenamed("text", "own").join(of_forms, ["length", "part", "segment"]).select("name", "own", "text", "place").distinct()

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["ratio"] = [indel_ratio(a, b) for a, b in zip(frame["own"], frame["text"])]
            yield frame.loc[frame["ratio"] >= LEAST_RATIO, ["name", "text", "place", "ratio"]]

    near = met.mapInPandas(compare, "name string, text string, place bigint, ratio double")
    best = near.groupBy("name").agg(F.min_by("text", F.struct(-F.col("ratio"), "place")).alias("form"))
    return best.select(F.col("name").alias(column), "form")


def resolve_entities(df: DataFrame, lexicon: DataFrame, column: str = "target_entity", fuzzy: bool = True) -> DataFrame:
    """Adds ent_canon and ent_type: exact form, form without white space, then fuzzy; else null and 'other'.

    Work is on the distinct entities, and what comes back is joined by entity, so a frequent entity
    is looked up once. Whether a lexicon is broadcast is Spark's choice by its size.
    """
    names = df.select(F.col(column).alias("_e")).where("_e IS NOT NULL").distinct()
    forms = lexicon.select(F.col("form"), F.col("canonical"), F.col("entity_type"))
    bare = forms.select(F.regexp_replace("form", r"(?U)\s+", "").alias("_bare"), F.struct("form", "canonical", "entity_type").alias("_b")).groupBy("_bare").agg(F.min("_b").alias("_b"))
    exact = names.join(forms, F.lower(F.trim("_e")) == F.col("form"), "left")
    both = exact.join(bare, F.regexp_replace(F.lower("_e"), r"(?U)\s+", "") == F.col("_bare"), "left")
    known = both.select("_e", F.coalesce("canonical", "_b.canonical").alias("ent_canon"), F.coalesce("entity_type", "_b.entity_type").alias("ent_type"))
    if fuzzy:
        near = fuzzy_lexicon(known.where("ent_canon IS NULL"), lexicon, "_e").join(forms, "form").select("_e", F.col("canonical").alias("_c"), F.col("entity_type").alias("_t"))
        known = known.join(near, "_e", "left").select("_e", F.coalesce("ent_canon", "_c").alias("ent_canon"), F.coalesce("ent_type", "_t").alias("ent_type"))
    out = df.join(known, df[column] == known["_e"], "left").drop("_e")
    return out.withColumn("ent_type", F.coalesce("ent_type", F.lit("other")))
