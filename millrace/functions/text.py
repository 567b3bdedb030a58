"""Text expressions: flags, dictionary matches, verbs, normalising, HTML items.

Whitespace means what it means in a Unicode text (VT, FS to US, NEL, no-break
and wide blanks included), written as one pattern so that every engine agrees.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import verbs

WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

# Words and phrases looked for in a claim description.
KEYWORDS = [
    "NECK", "BACK", "KNEE", "EYE", "FINGER", "STRUCK", "HAMMER", "LADDER", "STAIR", "FELT",
    "TRUCK", "MOTOR", "TRAUMA", "FELL", "LIFT", "CUT",
]
PHRASES = {
    "CD_FOREIGN_BODY": "FOREIGN BODY",
    "CD_BACK_STRAIN": "BACK STRAIN",
    "CD_SOFT_TISSUE_": "SOFT TISSUE",
    "CD_LOWER_BACK_STRAIN": "LOWER BACK STRAIN",
    "CD_LACERAT_": "LACERAT",
}
ACCIDENT_WORDS = ["STRUCK", "HAMMER", "LADDER", "STAIR", "FELT", "TRUCK", "MOTOR"]

# The body part list, and the words added to and removed from it.
BODY_PARTS = [
    "abdomen", "adam's apple", "adenoids", "adrenal gland", "anatomy", "ankle", "anus", "appendix", "arch", "arm",
    "artery", "back", "ball of the foot", "belly", "belly button", "big toe", "bladder", "blood", "blood vessels",
    "body", "bone", "brain", "breast", "buttocks", "calf", "capillary", "carpal", "cartilage", "cell",
    "cervical vertebrae", "cheek", "chest", "chin", "circulatory system", "clavicle", "coccyx", "collar bone",
    "diaphragm", "digestive system", "ear", "ear lobe", "elbow", "endocrine system", "esophagus", "eye", "eyebrow",
    "eyelashes", "eyelid", "face", "fallopian tubes", "feet", "femur", "fibula", "filling", "finger", "fingernail",
    "follicle", "foot", "forehead", "gallbladder", "glands", "groin", "gums", "hair", "hand", "head", "heart", "heel",
    "hip", "humerus", "immune system", "index finger", "instep", "intestines", "iris", "jaw", "kidney", "knee",
    "larynx", "leg", "ligament", "lip", "liver", "lobe", "lumbar vertebrae", "lungs", "lymph node", "mandible",
    "metacarpal", "metatarsal", "molar", "mouth", "muscle", "nail", "navel", "neck", "nerves", "nipple", "nose",
    "nostril", "organs", "ovary", "palm", "pancreas", "patella", "pelvis", "phalanges", "pharynx", "pinky",
    "pituitary", "pore", "pupil", "radius", "rectum", "red blood cells", "respiratory system", "ribs", "sacrum",
    "scalp", "scapula", "senses", "shin", "shoulder", "shoulder blade", "skeleton", "skin", "skull", "sole",
    "spinal column", "lumbar", "spine", "spleen", "sternum", "stomach", "tarsal", "teeth", "tendon", "testes",
    "thigh", "thorax", "throat", "thumb", "thyroid", "tibia", "tissue", "toe", "toenail", "tongue", "tonsils",
    "tooth", "torso", "trachea", "ulna", "ureter", "urethra", "urinary system", "uterus", "uvula", "vein", "vertebra",
    "waist", "white blood cells", "wrist",
]
BODY_PARTS_ADDED = [
    "feet", "hands", "wrists", "kidneys", "lungs", "teeth", "shoulders", "fingers", "knees",
    "toes", "arms", "eyes", "ears", "legs", "ankles",
]
BODY_PARTS_REMOVED = [
    "artery", "ball of the foot", "blood", "blood vessels", "body", "cell", "cervical vertebrae",
    "index finger", "big toe", "lobe", "muscle", "red blood cells", "white blood cells", "filling",
]

def word_list(text: str) -> list[str]:
    return [w.strip() for w in " ".join(text.split()).split(";") if w.strip()]


def edited_word_list(words: Column, added: Sequence[str], removed: Sequence[str]) -> Column:
    """Add words that are absent at the end, then take out the removed ones; order is kept."""
    return F.array_except(F.array_union(words, _texts(added)), _texts(removed))


def body_part_words() -> list[str]:
    """The edited body part list as a constant, in its order."""
    words = list(dict.fromkeys(BODY_PARTS + BODY_PARTS_ADDED))
    return [w for w in words if w not in BODY_PARTS_REMOVED]


def _texts(words: Sequence[str]) -> Column:
    """A constant array (one literal that is split when the plan is optimised)."""
    return F.split(F.lit(";".join(words)), ";")


def _in(words: Sequence[str], name: str) -> str:
    """SQL membership test; a long list becomes one hash lookup."""
    return f"{name} in ({', '.join(_quoted(w) for w in words)})"


def _quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def collapse(text: Column) -> Column:
    """Runs of whitespace to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def tokens(text: Column) -> Column:
    """Whitespace tokens; a blank text has none."""
    return F.array_remove(F.split(text, WHITE), "")


def _has(text: Column, word: str) -> Column:
    return F.contains(text, F.lit(word))


def keyword_flags(column: str = "ClaimDescription") -> dict[str, Column]:
    """0/1 columns for words and phrases (case-sensitive, anywhere in the text).

    The stress flag asks for a match after the first character: a text that
    starts with the word does not count.
    """
    text = F.col(column)
    flags = {f"CD_{w}": _has(text, w) for w in KEYWORDS}
    flags |= {name: _has(text, phrase) for name, phrase in PHRASES.items()}
    flags["CD_WORKPLACE_STRESS"] = (F.instr(text, "WORKPLACE STRESS") > 1) | (F.instr(text, "STRESS") > 1)
    flags["CD_LEFT_RIGHT"] = _has(text, "LEFT") | _has(text, "RIGHT")
    return {name: flag.cast("int") for name, flag in flags.items()}


def body_parts(df: DataFrame, column: str = "ClaimDescription") -> DataFrame:
    """Add up to three body parts, in word-list order, with a fallback for the first.

    Words of several tokens never match. Only tokens found in the list (a hash
    lookup) are then put in list order. Tokens and matches are columns of
    their own on the way, so each is computed once per row.
    """
    words = [w.upper() for w in body_part_words() if " " not in w]
    text, unknown = F.col(column), F.lit("Unknown")
    fallback = (
        F.when(_has(text, "FOREIGN BODY"), "foreign_body")
        .when(_has(text, "TRAUMA"), "stress")
        .when(_has(text, "CARPEL"), "wrist")
        .when(F.expr(f"exists(__tokens, w -> {_in(ACCIDENT_WORDS, 'w')})"), "external")
        .otherwise(unknown)
    )

    def part(n: int) -> Column:
        return F.lower(F.get("__found", F.lit(n)).getField("word"))

    listed = F.expr(f"array_distinct(filter(__tokens, w -> {_in(words, 'w')}))")
    place = F.transform(listed, lambda w: F.struct(F.array_position(_texts(words), w).alias("at"), w.alias("word")))
    return (
        df.withColumn("__tokens", tokens(text))
        .withColumn("__found", F.sort_array(place))
        .withColumns(
            {
                "BodyParts": F.coalesce(part(0), fallback),
                "BodyParts_Minor": F.coalesce(part(1), unknown),
                "BodyParts_Minor2": F.coalesce(part(2), unknown),
            }
        )
        .drop("__tokens", "__found")
    )


def cause_of_injury(
    df: DataFrame, column: str = "ClaimDescription", known: Sequence[str] | None = None, irregular: Mapping[str, str] | None = None
) -> DataFrame:
    """Add the first and second verb of a text as lemmas.

    Bare base forms stand for the second tagger: they count only in texts
    without an inflected verb. Everything happens inside the row, so a text is
    never exploded or shuffled; for a lexicon in a table there is ``verbs.text_verbs``.
    """
    known = verbs.bases() if known is None else known
    irregular = verbs.irregular_forms() if irregular is None else irregular
    hits = F.transform(tokens(F.lower(F.col(column))), lambda w: verbs.lemma_in_row(w, known, dict(irregular)))
    first, second = (F.coalesce(c, F.lit("Unknown")) for c in verbs.first_two(F.col("__hits")))
    return (
        df.withColumn("__hits", F.filter(hits, lambda h: h.isNotNull()))
        .withColumns({"CauseOfInjury": F.when(first == "fell", "fall").otherwise(first), "CauseOfInjury_Minor": second})
        .drop("__hits")
    )


def cause_flags(column: str = "CauseOfInjury") -> dict[str, Column]:
    """Flags for single causes. A flag for "lift" would clash with CD_LIFT and is not kept."""
    return {f"CD_{name}": F.coalesce(F.col(column) == name, F.lit(False)).cast("int") for name in ("drive", "bend", "burn")}


def newline_to_blank(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def capitalise(text: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**31 - 1)))


def to_base64(text: Column) -> Column:
    """Base64 of the UTF-8 bytes in one line, whether or not the session cuts such lines."""
    return F.replace(F.base64(F.encode(text, "UTF-8")), F.lit("\r\n"), F.lit(""))


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    """Put values for ``{name}`` marks in a template.

    The template is cut at its marks once, here; the row work is one
    ``concat``, so a value that itself contains ``{name}`` is left as it is.
    """
    pieces: list[Column] = []
    rest = template
    while rest:
        marks = [(rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not marks:
            pieces.append(F.lit(rest))
            break
        at, name = min(marks)
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(values[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces) if pieces else F.lit("")


def html_items(html: Column, tag: str = "li") -> Column:
    """Texts of all ``<tag>`` elements, tags in any case: inner markup stripped, lower case.

    An item that is not closed ends at the next item, at the end of its list, or with the page.
    """
    item = f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)(?=</?{tag}[\\s>]|</[uo]l\\s*>|\\z)"
    inner = F.regexp_extract_all(html, F.lit(item), F.lit(1))
    return F.transform(inner, lambda x: F.lower(F.regexp_replace(x, "<[^>]*>", "")))
