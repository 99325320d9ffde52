"""Operator 10: secrets by fixed patterns and by character Markov models, in DataFrame functions only."""

from __future__ import annotations

import base64
import random
import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointmill.llm.common import materialize, unused

# The base kinds in their listed order, their patterns, the group whose length counts and its least length.
# A match of the last two is a whole run of characters, so asking for the least length in the pattern finds the same ones.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
METHOD = "markov"
#: Tokens that the models judge, and the least length of one.
TOKEN, TOKEN_LENGTH = r"[A-Za-z0-9+/_=-]{20,}", 20
#: A token is a secret if its log-likelihood ratio per character, random against ordinary, is at least this many nats.
MARGIN = 0.35
_CLASSES = 64
#: Characters of the slices that a masked text is put together from.
STEP = 256
_END = 2**31 - 1
PULL = 4.0
_QUICK = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|[A-Za-z0-9+/_=-]{20}"""
_SPAN = "array<struct<start:int,kind:int,name:string,end:int,value:string>>"


def _let(value: Column, f) -> Column:
    """f of the value, which is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _scan(values: Column, merge, start: int) -> Column:
    """Prefixes of a short array; every step copies what is there."""

    def step(acc: Column, x: Column) -> Column:
        now = merge(acc["at"], x)
        return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))

    return F.aggregate(values, F.struct(F.lit(start).alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]


def _in_parts(values: Column, size: Column, merge, start: int, outer) -> Column:
    """Prefixes within parts of ``size``, each merged with those before it, which ``outer`` gives from the parts' last ones."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda j: _scan(F.slice(values, j * size + 1, size), merge, start))

    def joined(parts: Column) -> Column:
        before = F.concat(F.array(F.lit(start)), outer(F.transform(parts, lambda p: F.element_at(p, -1))))
        return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), lambda p, o: F.transform(p, lambda x: merge(o, x))))

    return _let(parts, joined)


def running(values: Column, merge, start: int) -> Column:
    """merge(start, values[0]), merge(that, values[1]), ...: by parts of parts, so that n values cost n ** (4 / 3) copied integers; merge is associative."""
    root = lambda v, f: F.ceil(f(F.size(v).cast("double"))).cast("int")
    two = lambda v: _let(v, lambda w: _in_parts(w, root(w, F.sqrt), merge, start, lambda x: _scan(x, merge, start)))
    return _let(values, lambda v: F.when(F.size(v) <= 32, _scan(v, merge, start)).otherwise(_in_parts(v, root(v, F.cbrt), merge, start, two)))


def _found(text: Column, kind: int, name: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as spans in code points; those whose group is shorter than ``least`` are dropped.

    The pieces between the matches give the positions: a match ends after all pieces and matches up to it.
    """
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def spans(both: Column) -> Column:
        long = F.zip_with(F.slice(pieces, 1, F.size(both)), both, lambda p, x: F.length(p) + F.length(x["w"]))

        def span(x: Column, end: Column) -> Column:
            return F.struct((end - F.length(x["w"])).alias("start"), F.lit(kind).alias("kind"), F.lit(name).alias("name"), end.alias("end"), x["g"].alias("value"))

        return F.filter(F.zip_with(both, running(long, lambda x, y: x + y, 0), span), lambda s: F.length(s["value"]) >= least)

    return F.when(text.rlike(pattern), _let(F.arrays_zip(whole.alias("w"), judged.alias("g")), spans)).otherwise(F.array().cast(_SPAN))


def _untouched(spans: Column, tokens: Column) -> Column:
    """The tokens that no base match overlaps, by one pass over both in order: the furthest base end before, the nearest base start behind."""

    def pick(both: Column) -> Column:
        is_base = lambda s: s["kind"] < len(BASE)
        ends = running(F.transform(both, lambda s: F.when(is_base(s), s["end"]).otherwise(F.lit(0))), F.greatest, 0)
        starts = F.reverse(running(F.reverse(F.transform(both, lambda s: F.when(is_base(s), s["start"]).otherwise(F.lit(_END)))), F.least, _END))
        free = F.filter(F.arrays_zip(both.alias("s"), ends.alias("e"), starts.alias("b")), lambda x: ~is_base(x["s"]) & (x["e"] <= x["s"]["start"]) & (x["b"] >= x["s"]["end"]))
        return F.transform(free, lambda x: x["s"])

    return F.when((F.size(spans) == 0) | (F.size(tokens) == 0), tokens).otherwise(_let(F.array_sort(F.concat(spans, tokens)), pick))


def base_spans(docs: DataFrame, spans: str = "spans", tokens: str = "tokens") -> DataFrame:
    """``docs`` (text not null) with ``spans``, the base matches by start, then kind, and ``tokens``, the spans that the models judge.

    A token that touches a base match is not judged.
    """
    text = F.col("text")
    quick = text.rlike(_QUICK)
    none = F.array().cast(_SPAN)
    base = F.concat(*(_found(text, k, *kind) for k, kind in enumerate(BASE)))
    out = docs.withColumn(spans, F.when(quick, F.array_sort(base)).otherwise(none))
    out = out.withColumn(tokens, F.when(quick, _found(text, len(BASE), METHOD, TOKEN, 0, TOKEN_LENGTH)).otherwise(none))
    return out.withColumn(tokens, _untouched(F.col(spans), F.col(tokens)))


def _char_class(code: Column) -> Column:
    """Letters in either case, digits, and one class for the rest, as 0 to 62; 63 stands before the first character."""
    return (
        F.when(code.between(97, 122), code - 97)
        .when(code.between(65, 90), code - 39)
        .when(code.between(48, 57), code + 4)
        .otherwise(62)
    )


def _steps(value: Column) -> Column:
    """The transitions of a string: previous class * 64 + class, one per character."""
    codes = F.transform(F.split(value, ""), lambda c: _char_class(F.ascii(c)))
    codes = F.slice(codes, 1, F.length(value))
    before = F.concat(F.array(F.lit(_CLASSES - 1)), F.slice(codes, 1, F.greatest(F.length(value) - 1, F.lit(0))))
    return F.zip_with(before, codes, lambda a, b: a * _CLASSES + b)


# The words of the ordinary samples.
_WORDS = """able about above access account action active actual address after again agent alert align allow already also always amount analysis
angle another answer any append apply archive area argument around array article assert async attach attempt author available average back badge
balance base batch because become before begin behind below best between binary bind block board body book both bottom boundary branch break bridge
bright broadcast brown browser buffer build bundle button cache calendar call cancel canvas capture card case catalog category center change
channel character check child choose city class clean client clock close cloud cluster code collect color column command comment commit common
community company compare compile complete component compress compute config connect console constant contact contain content context control
convert copy core corner correct cost count country course cover create credit current cursor custom customer data date debug decision default
define delete delta deploy depth describe design detail develop device dialog dictionary different digit direct disable discover display distance
document domain double download draft drive driver duplicate dynamic each early edge edit effect element else email embed empty enable encode end
engine enough enter entity entry enum environment equal error escape estimate event every evidence exact example except exchange execute exist exit
expand expect export express extend extra extract factor failure false family feature fetch field figure file filter final find first fixed flag
float flow focus folder follow force form format forward found frame free frequency from front full function future gate general generate get give
global good graph gray great green grid ground group growth guard guess guide handle hash have head header health height hello help hidden high
history home hook host house human icon identity ignore image import improve include index info inherit initial inline input insert inside
instance integer interface internal interval invalid invoice is issue item iterate job join journey jump just keep kernel key keyboard kind knowledge
label language large last late layer layout lead learn left legal length level library license life light like limit line link list listen little
load local location lock log logic long lookup loop lower machine main make manage manifest many map margin mark market mask master match matrix
maximum measure media member memory menu merge message method metric middle minimum minute mirror missing mobile mode model module moment money
monitor month more most mount move multiple name native near need nested network never next night node normal note nothing notice number object
observe offset often online only open operator option orange order organic origin other output outside over owner package padding page paint panel
paper parallel parameter parent parse part partition password path pattern pause payment people percent perform period permission person phase
phone physical picture piece pixel place plan plane platform play plugin point policy pool popular port position possible power prefix prepare present
preview previous price primary print priority private problem process product profile program progress project promise prompt property protocol provider
public publish purple push python quality quantity query question queue quick quiet quote radius random range rate ratio reach read ready reason
receive recent record red reduce reference refresh region register reject related release remote remove rename render repeat replace reply report
request require reset resolve resource response rest result retry return review right river rollback room root rotate round route row rule run
safe sample save scale scan schedule schema scope score screen script search season second secret section secure segment select self send sequence serial
server service session set setting shadow shape share sheet shift short should show side signal silent similar simple single size skip sleep slice
small smooth snapshot social socket software some sort source space spark special speed split square stack staff stage standard start state static
station status step still stop storage store stream street string strong structure student style subject submit subset success suffix suggest sum
summary super supply support switch symbol sync syntax system table target task team template temporary term test text thank their theme there thing
thread threshold through ticket time title today toggle token tool top topic total touch trace track trade traffic train transform tree trigger true trust
tuple turn type under union unique unit until update upload upper usage use user utility valid value variable vector verify version vertical video view
virtual visible visit volume wait walk warning watch water weather week weight welcome where which white width window winter with without word work worker
world wrap write yellow yesterday yield young zero zone
abbildung anwendung arbeit aufgabe ausgabe bearbeitung bedingung beispiel benutzer bereich bestellung buch daten ein eingabe einstellung entwicklung
ergebnis fehler freiheit geschichte gesellschaft gesundheit heute kunde lang mehr meldung nachricht pflege rechnung sicherheit sprache
schnell strasse uebersicht verarbeitung verbindung vergleich verlauf verwaltung wirklichkeit zahlung zeit zeitung zukunft zwischen
achat adresse aujourd avec bureau chaque commande compte connaissance donnees enregistrement environnement erreur exemple fichier fonction heureux
journal langue maison mise nouveau numero paiement personne quelque recherche semaine utilisateur valeur voyage
ahora archivo ayuda busqueda calle cantidad ciudad codigo cuenta desarrollo direccion ejemplo empresa hacer informacion mensaje mundo nombre
numero pagina palabra pedido pregunta respuesta seguridad siguiente tiempo trabajo usuario valores ventana""".split()


def random_string(kind: str, length: int, rng: random.Random) -> str:
    """A key of a kind: base62, base64, base64url, base32, hex, HEX or base36."""
    if kind in ("base64", "base64url"):
        made = (base64.b64encode if kind == "base64" else base64.urlsafe_b64encode)(rng.randbytes(length)).decode()
        return made[:length] if rng.random() < 0.5 else made
    letters = {"base62": string.ascii_letters + string.digits, "base32": string.ascii_uppercase + "234567", "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF"}
    return "".join(rng.choices(letters.get(kind, string.ascii_lowercase + string.digits), k=length))


def ordinary_string(rng: random.Random, words: list[str] = _WORDS) -> str:
    """An identifier, path, date, UUID, grouped or plain number, or ruler, of TOKEN_LENGTH characters or more."""
    style = rng.randrange(14)
    if style == 0:
        return str(uuid.UUID(int=rng.getrandbits(128), version=4))
    if style == 1:
        return "-".join(f"{rng.randrange(10**4):04d}" for _ in range(rng.randrange(4, 8)))
    if style == 2:
        return "".join(rng.choices(string.digits, k=rng.randrange(20, 33)))
    if style == 3:
        return rng.choice("-=_+/") * rng.randrange(20, 80)
    parts: list[str] = []
    while sum(map(len, parts)) + len(parts) - 1 < TOKEN_LENGTH:
        parts.append(rng.choice(words))
    if style in (4, 5):
        return "".join(p.capitalize() for p in parts) if style == 4 else parts[0] + "".join(p.capitalize() for p in parts[1:])
    if style == 6:
        return "_".join(parts).upper()
    if style == 7:
        return "".join(parts)
    if style in (8, 9, 10):
        return ("_", "-", "/")[style - 8].join(parts)
    date = f"{rng.randrange(1990, 2040)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
    if style == 11:
        return f"{date}T{rng.randrange(24):02d}-{rng.randrange(60):02d}-{rng.randrange(60):02d}" + rng.choice(("Z", "-" + parts[0]))
    tail = str(rng.choice((rng.randrange(10), rng.randrange(100), rng.randrange(1990, 2040), rng.randrange(10**6))))
    return rng.choice("_-").join([*parts, rng.choice((tail, "v" + tail, date))]) if style == 12 else "".join(p.capitalize() for p in parts) + tail


def representative_samples(spark: SparkSession, each: int = 600) -> DataFrame:
    """(value, secret) of fixed size and content: keys of all usual alphabets, and ordinary long tokens."""
    rng = random.Random(10)
    kinds = ("base62", "base64", "base64url", "base32", "hex", "HEX", "base36")
    rows = [(random_string(kind, rng.randrange(20, 65), rng), True) for kind in kinds for _ in range(each)]
    rows += [(ordinary_string(rng), False) for _ in range(14 * each)]
    return spark.createDataFrame(rows, "value string, secret boolean")


def fit(samples: DataFrame) -> DataFrame:
    """One row with ``ratio``, the log-likelihood ratio of every transition (64 * 64 doubles), from (value, secret) rows.

    Transitions of all samples are counted with map-side sums and smoothed by PULL pseudo-counts of the classes' own frequencies.
    Without samples of both kinds the ratio says nothing: it is 0 or near it.
    """
    steps = samples.filter("value IS NOT NULL AND secret IS NOT NULL").select("secret", F.explode(_steps(F.col("value"))).alias("step"))
    counts = materialize(steps.groupBy("step").agg(F.count_if("secret").alias("s"), F.count_if(~F.col("secret")).alias("o")), "transitions")
    grid = samples.sparkSession.range(_CLASSES * _CLASSES).select(F.col("id").cast("int").alias("step"))
    full = grid.join(counts, "step", "left").na.fill(0).withColumns({"before": F.floor(F.col("step") / _CLASSES), "after": F.col("step") % _CLASSES})

    def log_p(n: str) -> Column:
        """Of a transition, drawn towards how often its second class occurs at all."""
        of = lambda *by: F.sum(n).over(W.partitionBy(*by))  # noqa: E731  sums of 4,096 rows
        alone = (of("after") + 0.1) / (of() + 0.1 * _CLASSES)
        return F.log((F.col(n) + PULL * alone) / (of("before") + PULL))

    ratio = full.select("step", (log_p("s") - log_p("o")).alias("r"))
    cells = F.array_sort(F.collect_list(F.struct("step", "r")))  # 4,096 rows whatever the input
    return ratio.agg(F.transform(cells, lambda x: x["r"]).alias("ratio"))


def _judged(docs: DataFrame, spans: str, samples: DataFrame | None, margin: float) -> DataFrame:
    """``docs`` with null texts as empty, and the spans of both in the column ``spans``."""
    tokens, ratio = unused(docs, "tokens"), unused(docs, "ratio")
    found = base_spans(docs.withColumn("text", F.coalesce("text", F.lit(""))), spans, tokens)
    model = fit(representative_samples(docs.sparkSession) if samples is None else samples)

    def per_char(value: Column) -> Column:
        return F.aggregate(_steps(value), F.lit(0.0), lambda acc, i: acc + F.element_at(ratio, i + 1)) / F.length(value)

    secret = F.filter(tokens, lambda t: per_char(t["value"]) >= margin)
    out = found.crossJoin(F.broadcast(model.withColumnRenamed("ratio", ratio)))  # one row of 4,096 numbers
    return out.withColumn(spans, F.array_sort(F.concat(spans, secret))).select(*docs.columns, *([] if spans in docs.columns else [spans]))


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, margin: float = MARGIN) -> DataFrame:
    """``docs`` (doc_id, text, ...) with null texts as empty, plus ``spans`` of struct(start, kind, name, end, value) by start, then kind.

    Base matches always stay. The method adds tokens of 20 characters or more that touch no base match and are likelier, by ``margin`` nats a
    character, under the Markov model of random strings than under that of ordinary identifiers. Both models are fitted on ``samples`` (value,
    secret), by default on :func:`representative_samples`. Time grows as n ** (4 / 3) with the matches of a text. Defined cases: null or empty text
    has no spans; without any sample the ratio is 0 and the method adds nothing; repeated rows get equal spans; spans count code points over
    whole texts; a column ``spans`` of the input is replaced, all others stay.
    """
    return _judged(docs, "spans", samples, margin)


def redact(docs: DataFrame, mask: str = "[SECRET]", samples: DataFrame | None = None, margin: float = MARGIN) -> DataFrame:
    """``docs`` with every secret of their texts replaced by ``mask``; overlapping spans count as one. Other columns stay, whatever their names.

    The text is put together from slices of STEP characters, so that no gap is looked for from the start of the text again. Defined cases as for
    :func:`find_secrets`; a null text stays null.
    """
    spans, slices, null = unused(docs, "spans"), unused(docs, "slices"), unused(docs, "null")
    found = _judged(docs.withColumn(null, F.col("text").isNull()), spans, samples, margin)
    found = found.withColumn(slices, F.when(F.size(spans) > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STEP}}}"), F.lit(0))))

    def between(start: Column, end: Column) -> Column:
        """The text from start to end, from the slices they lie in and those between."""
        a, b = F.floor(start / STEP).cast("int"), F.floor(end / STEP).cast("int")
        at = lambda k: F.coalesce(F.get(slices, k), F.lit(""))
        head, tail = F.substring(at(a), start - a * STEP + 1, F.lit(STEP)), F.substring(at(b), F.lit(1), end - b * STEP)
        inner = F.array_join(F.slice(slices, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
        return F.when(a == b, F.substring(at(a), start - a * STEP + 1, end - start)).otherwise(F.concat(head, inner, tail))

    def clean(ends: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
        gaps = F.filter(F.zip_with(spans, before, lambda s, b: F.struct(b.alias("b"), s["start"].alias("e"))), lambda g: g["e"] >= g["b"])
        whole = F.transform(gaps, lambda g: F.concat(between(g["b"], g["e"]), F.lit(mask)))
        return F.concat(F.array_join(whole, ""), between(F.element_at(ends, -1), F.length("text")))

    masked = _let(running(F.transform(spans, lambda s: s["end"]), F.greatest, 0), clean)
    text = F.when(~F.col(null), F.when(F.size(spans) > 0, masked).otherwise(F.col("text")))
    return found.withColumn("text", text).select(*docs.columns)


def secret_digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of the output of :func:`find_secrets`."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
