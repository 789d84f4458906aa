"""Rule tables and word lists. Rules are arguments everywhere; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Dutch month names, words without a subject of their own, abbreviations before a full
# stop, and status names, as the texts to be matched use them.
MONTHS = ("januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december")
QUESTION_STOP = tuple(
    "de het een en van voor op in is wat hoe wanneer moet ik mijn als dat die met te aan of dit naar uw u kan kun ben zijn er bij ook om nog wel niet "
    "wij we jij je me mij over per tot zo maar dan nu wie waar welke welk waarom waarvoor gaan gaat wordt worden zou zullen moeten kunnen".split()
)
# Words without a subject of their own in titles.
TITLE_STOP = tuple(
    "de het een en of van voor met bij op aan is zijn wat hoe je jouw uw u dit die dat als om te in naar over uit niet zo werkt wordt worden kan kunt moet "
    "moeten welke wanneer deze dan ook per".split()
)
# Words without a subject of their own in texts.
DETAIL_STOP = tuple(
    "de het een en of van voor met bij op aan in te die dat dit deze als om naar over uit niet ook wel zijn is wordt worden kan moet moeten hun zij je u uw "
    "er dan wanneer waarvan waarbij mits tenzij indien alleen hebben heeft jaar per tot nog al meer minder".split()
)
CUES = tuple(
    "die dat dit deze hem haar ze zij erin erop ermee erover ervan ervoor erna eraan daarin daarop daarmee daarover daarvan daarvoor daaraan daar "
    "hierin hierop hiermee hierover hiervan hiervoor".split()
)
ABBREVIATIONS = ("bijv", "bv", "o.a", "m.b.t", "i.p.v", "d.w.z", "nr", "art", "ca", "incl", "excl", "zgn", "e.d", "t.o.v", "mr", "dr", "drs", "ir", "prof")
# Words of questions that a kept text alone does not answer.
PERSONAL = r"(?i)\b(?:hoeveel|voordeliger|goedkoper|beter|verschil|moet ik|mag ik|kan ik|voor mij|mijn situatie)\b"
TENTATIVE = ("voorstel", "consultatie", "voornemen")
ALIASES = {"arbeidsongeschiktheidsverzekering": ("arbeidsongeschiktheid", "basisverzekering")}


@dataclass(frozen=True)
class Term:
    """A term rule: every one of ``all`` and one of ``any`` must occur; ``unless`` cancels an exclusion."""

    all: tuple[str, ...] = ()
    any: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    category: str | None = None
    scope: str = "text"


@dataclass(frozen=True)
class Rules:
    """What decides on relevance and category; orders of mappings are orders of preference."""

    categories: dict[str, tuple[str, ...]]
    audiences: dict[str, tuple[str, ...]] = field(default_factory=dict)
    important: tuple[str, ...] = ()
    whole_words: tuple[str, ...] = ()
    broad: tuple[str, ...] = ()
    signals: tuple[Term, ...] = ()
    exclusions: tuple[Term, ...] = ()
    strong: tuple[str, ...] = ()
    comparisons: tuple[str, ...] = ()
    general: tuple[str, ...] = ()
    legal_form: str = ""
    default: str = "overig"


#: Rules over the vocabulary of the sample documents.
SAMPLE = Rules(
    categories={"bouw": ("keit", "lich"), "zorg": ("eaux", "elle"), "handel": ("ción", "mente"), "werk": ("thing", "ation"), "vorm": ("under", "und")},
    audiences={"starter": ("license", "licensed"), "werkgever": ("ering", "ung"), "particulier": ("tion",)},
    important=("token", "apache"),
    whole_words=("und", "under"),
    broad=("ation", "elle"),
    signals=(Term(all=("the", "of"), any=("license", "worthless"), category="werk"), Term(any=("schaft", "ierung"), category="bouw"), Term()),
    exclusions=(Term(any=("idiot",), unless=("license",)), Term(any=("gnu",), scope="title")),
    strong=("lytion", "keiten"),
    comparisons=("thereas", "ciónes"),
    general=("ontion", "eneaux"),
    legal_form="vorm",
)
