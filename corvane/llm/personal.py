"""Personal information in texts: found by bootstrapped contextual extraction, replaced by typed placeholders.

Broad grammars propose spans of each kind; far more of them than there are true ones (batch numbers look like phones, cohorts like
names). Seeds are the spans that their strict form or a title settles: plain addresses with an @, international or bracketed phone
numbers, numbers with letters or slashes of their own, streets with house number and town, words behind a title such as Dr. From
there, scores spread over the graph of items (forms of numbers, domains, streets and towns, words of names) and lexical patterns (the
tokens left, right and on both sides of a span): a pattern is as good as the items it holds, an item as good as the patterns
that hold it. After ROUNDS rounds every span, seeds too, is decided by the weights of its patterns and items. Strong
patterns then propose spans of their own wherever they stand: names in lower case behind or before them, numbers and addresses in
forms that no grammar knows behind them; these are decided by the same weights. Overlapping spans are settled by kind, score, then length.

Spans count in code points. Texts are taken whole. Null and empty texts have none. Texts that repeat give the same spans.
Scores are computed over all texts, and count by share with a steady prior, not by thresholds of numbers; nothing about single documents
reaches the driver. Strong patterns go to the tasks in blocks of at most BLOCK, one pass over the texts for each.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvane.session import Scratch, attach, spread as spread_out

ROUNDS = 4
#: Left patterns from this weight on propose spans; so many at once.
STRONG, BLOCK = 0.75, 50_000
#: The share of all places of such a pattern that hold good items.
HELD = 0.2
#: How much an item that isn't known counts against a pattern, of what a good one counts for it.
UNKNOWN = 0.25
KINDS = ("email", "phone", "id_number", "address", "name")
S = "[    ]"

# Words that mark streets, boxes and titles, in the languages of the texts.
STREETS_AFTER = "Street Lane Road Avenue Boulevard Court Drive Way Square Terrace".split()
STREETS_SHORT = "St Ln Rd Ave Blvd Ct".split()
STREETS_END = "straße strasse str weg platz gasse allee".split()
STREETS_ES = "Calle Avenida Avda Plaza Paseo".split()
STREETS_FR = "rue avenue place boulevard allée impasse chemin".split()
TITLES = "dr dra prof nurse mr mrs ms frau herr mme sra sr".split()
PARTICLES = "de van von der da di del la le".split()


def grammars() -> dict:
    import regex

    dot = rf"(?:\.|{S}\.{S}|{S}?[\[(]{S}?dot{S}?[\])]{S}?|{S}dot{S})"
    label = r"(?=[\p{N}-]*\p{L})[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
    # signs that are rare come first, what stands left of them is read backwards
    at = rf"(?:@|[\[(]{S}?at{S}?[\])]|(?<={S})at(?={S}))"
    host = rf"{at}{S}?{label}(?:{dot}{label})*{dot}\p{{L}}{{2,}}(?![\p{{L}}\p{{N}}])"
    local = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}](?:[\p{L}\p{N}._%+-]*[\p{L}\p{N}])?(?=" + S + "?$)"
    hyphen = "[-‐‑–]"
    sep = rf"(?:{S}?/{S}?|{S}|[.]|{hyphen})"
    phone = rf"(?<![\p{{L}}\p{{N}}/.,_#|-])(?:\+\d{{1,3}}{sep}?|00\d{{2}}{sep})?(?:\(\d{{2,5}}\){S}?)?\d(?:{sep}?\d){{5,13}}(?:{S}?,?{S}?(?:x|ext\.?|extension|Durchwahl|poste){S}?\d{{1,5}})?(?![\p{{L}}\p{{N}}])"
    number = rf"(?<![\p{{L}}\p{{N}}/.,_#+-])(?:\p{{Lu}}{{2}}(?:{S}?\d\d){{3}}{S}?\p{{Lu}}|\p{{Lu}}{hyphen}?\d{{7,8}}(?:{hyphen}?\p{{Lu}})?|\d{{8}}{hyphen}?\p{{Lu}}|\d{{2,4}}/\d{{3}}/\d{{4,5}}|\d{{3}}{sep}\d{{2}}{sep}\d{{4}}|\d{{9}})(?![\p{{L}}\p{{N}}])"
    street, town = r"\p{Lu}[\p{L}'’-]+", r"\p{Lu}[\p{L}'’-]+"  # one word: the next may begin a sentence
    flat = r"(?:Flat|Apt\.?|Unit|Suite)[ ]\d+\w?"
    en = rf"(?:{flat},[ ])?\d+\w?(?:[-–]\d+)?[ ](?:(?:North|South|East|West)[ ])?{street}[ ](?:(?:{'|'.join(STREETS_AFTER)})(?!\p{{L}})|(?:{'|'.join(STREETS_SHORT)})(?!\p{{L}})\.?)(?:,[ ]{flat})?(?:,[ ]{town}(?:[ ]\d{{5}}(?!\d))?)?"
    box = rf"(?:P\.?[ ]?O\.?[ ]Box|Postfach|Apartado|BP)[ ]\d+(?:,[ ](?:\d{{5}}[ ])?{town}(?:[ ]\d{{5}}(?!\d))?)?"
    ending = rf"(?<=\p{{L}})(?:{'|'.join(STREETS_END)})\.?[ ]\d+\w?(?:,[ ]\d{{5}}[ ]{town})?".replace("[ ]", S)
    stem = rf"(?<![\p{{L}}\p{{N}}])(?:(?:Am|An[ ]der)[ ])?\p{{L}}[\p{{L}}'’-]*$".replace("[ ]", S)
    es = rf"(?:C/|(?:{'|'.join(STREETS_ES)})\.?)[ ](?:de[ ](?:la[ ])?)?{street},?[ ]\d+\w?(?:,[ ]\d+\.?º[ ]?\w?)?(?:,[ ](?:\d{{5}}[ ])?{town})?"
    fr = rf"\d+(?:[ ](?:bis|ter))?,?[ ](?:{'|'.join(STREETS_FR)})[ ](?:de[ ](?:la[ ])?|du[ ]|des[ ])?{street}(?:,[ ](?:\d{{5}}[ ])?{town})?"
    address = (rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join((en, box, es, fr))})").replace("[ ]", S)
    # a word of a name in any case; which case it may have is settled by the whole
    one = r"\p{L}[\p{L}'’]+(?:-\p{L}[\p{L}'’]+)?"
    particle = rf"(?:(?i:{'|'.join(PARTICLES)}){S})"

    def names(letter: str) -> list:
        """The forms of a name all words of which begin with such a letter, but for particles."""
        word = rf"{letter}[\p{{L}}'’]+(?:-\p{{L}}[\p{{L}}'’]+)?"
        first = rf"(?:{word}|{letter}\.)"
        given = [S.join([first] * n) for n in (1, 2, 3)]
        forms = [form for x in given for form in (rf"{x}{S}{particle}?{word}", rf"{particle}?{word},{S}{x}")]
        return [regex.compile(rf"{f}(?![\p{{L}}\p{{N}}'’-])") for f in forms]

    word = rf"(?:\p{{Lu}}[\p{{L}}'’]+(?:-\p{{L}}[\p{{L}}'’]+)?|\p{{Lu}}\.)"
    # two or more words of a name; and where in it a name may begin: at a capital or at a particle
    run = rf"(?<![\p{{L}}\p{{N}}.'’-]){particle}?{word}(?:,?{S}{particle}?{word})+"
    begin = rf"(?<![\p{{L}}\p{{N}}.'’-])(?:\p{{Lu}}|(?={particle}\p{{L}}))"
    # any word that an address may be known by
    street = rf"\b(?:{'|'.join((*STREETS_AFTER, *STREETS_SHORT, *STREETS_ES, *STREETS_FR, 'Box', 'Postfach', 'Apartado', 'BP'))})\b|\bC/|(?:{'|'.join(STREETS_END)})\.?[  ]"
    # what a strong pattern may bring up: a number of any form, a place with a number, two or three words
    anything = {"phone": r"[+(]?\d[\d ./()-]{4,18}\d", "id_number": r"(?=[\p{Lu}\d./ -]*\d{3})[\p{Lu}\d][\p{Lu}\d./ -]{3,16}[\p{Lu}\d]", "address": rf"(?:\d+\w?,?{S})?(?:\p{{Lu}}[\p{{L}}'’-]+{S}){{1,3}}\d+\w?|\d+\w?,?{S}\p{{L}}+{S}\p{{Lu}}[\p{{L}}'’-]+|\d+\w?{S}\p{{Lu}}[\p{{L}}'’-]+{S}\p{{Lu}}[\p{{L}}'’-]+"}
    case = regex.IGNORECASE
    return {"host": regex.compile(host, case), "local": regex.compile(local), "ending": regex.compile(ending, case), "stem": regex.compile(stem, case), "phone": regex.compile(phone, case), "id_number": regex.compile(number), "address": regex.compile(address, case), "upper": names(r"\p{Lu}"), "lower": names(r"\p{Ll}"), "run": regex.compile(run), "start": regex.compile(begin), "street": re.compile(street, re.IGNORECASE), "anything": {k: regex.compile(v + r"(?![\p{L}\p{N}])") for k, v in anything.items()}, "token": regex.compile(r"\p{L}+|\d+|\n|[^\s\p{L}\d]"), "word": regex.compile(rf"(?:{one}|\p{{L}}\.)"), "words": regex.compile(rf"(?<![\p{{L}}\p{{N}}.'’-])\p{{L}}[\p{{L}}.'’-]*(?:,?{S}[\p{{L}}.'’-]+){{1,4}}$")}


def digits_as(text: str) -> str:
    return "".join("#" if c.isdigit() else "A" if c.isalpha() and c.isupper() else "a" if c.isalpha() else " " if c.isspace() else "-" if c in "‐‑–" else c for c in text)


def name_case(words: list[str]) -> str | None:
    """How the words of a name are written: T (capitalised), U (all upper case), l (all lower case); None if mixed."""
    own = [w for w in words if w.lower() not in PARTICLES]
    long = [w for w in own if len(w) > 2 or not w.endswith(".")]
    if len(own) < 2 or words[-1].lower() in PARTICLES or not long or any(w.lower().rstrip(".") in SLOT_WORDS for w in own) or not all(w[0].isupper() for w in own) and not all(w[0].islower() for w in own):
        return None
    if own[0][0].islower():
        return "l" if all(w.islower() for w in words) else None
    if all(w.isupper() for w in long):
        return "U"
    return "T" if all(not w.isupper() for w in long) else None


def domain_items(host: str) -> list[str]:
    """The parts of a domain, however its signs are spelt."""
    import regex

    return [w.lower() for w in regex.findall(r"[\p{L}\p{N}-]+", host) if w.lower() not in ("at", "dot")]


def address_items(value: str) -> list[str]:
    """The word that marks the street, and the town."""
    low = value.lower()
    word = next((w for w in (*STREETS_AFTER, *STREETS_SHORT, *STREETS_ES, *STREETS_FR, *STREETS_END, "Box", "Postfach", "Apartado", "BP", "C/") if w.lower() in low), "")
    town = value.rsplit(",", 1)[1].strip(" 0123456789").lower() if "," in value else ""
    return [f"street {word.lower()}"] + ([f"town {town}"] if town else [])


def spans(text: str, g: dict) -> Iterator[tuple[str, int, int, list[str], bool]]:
    """(kind, start, end, items, seed) of all that the grammars propose."""
    if "@" in text or "at" in text or "AT" in text or "At" in text:
        for m in g["host"].finditer(text):
            if left := g["local"].search(text, max(0, m.start() - 64), m.start()):
                plain = text[m.start()] == "@" and left.end() == m.start() and not any(c.isspace() or c in "[(" for c in m[0])
                yield "email", left.start(), m.end(), domain_items(m[0].lstrip("@")), plain
    for m in g["phone"].finditer(text):
        if sum(c.isdigit() for c in m[0]) >= 8:
            core = digits_as(m[0]).lower().split("x")[0].split("e")[0].rstrip(" ,")
            yield "phone", m.start(), m.end(), [core], core[0] in "+("
    for m in g["id_number"].finditer(text):
        shape = digits_as(m[0])
        yield "id_number", m.start(), m.end(), [shape], any(c in "A/" for c in shape)
    if g["street"].search(text):
        streets = [(m.start(), m.end()) for m in g["address"].finditer(text)]
        streets += [(left.start(), m.end()) for m in g["ending"].finditer(text) if (left := g["stem"].search(text, max(0, m.start() - 64), m.start()))]
        for begin, end in streets:
            value = text[begin:end]
            yield "address", begin, end, address_items(value), "," in value and any(c.isdigit() for c in value)
    for m in g["run"].finditer(text):
        for at in g["start"].finditer(text, m.start(), m.end()):
            yield from named_at(text, at.start(), g["upper"], g)


def named_at(text: str, begin: int, forms: list, g: dict) -> Iterator[tuple[str, int, int, list[str], bool]]:
    """All readings of a name that begin here."""
    for form in forms:
        if m := form.match(text, begin):
            words = [w[0] for w in g["word"].finditer(m[0])]
            if name_case(words):
                yield "name", begin, m.end(), [w.lower() for x in words if len(x) > 2 and x.lower() not in PARTICLES for w in x.split("-")], title_before(text, begin)


# Words that stand before a person.
SLOT_WORDS = {*TITLES, "de", "patient", "patientin", "paciente", "by", "for", "ansprechpartner", "von", "par", "por", "contact", "kontakt", "name", "reporter", "regards", "cordialement", "atentamente", "grüßen"}


def title_before(text: str, start: int) -> bool:
    left = text[max(0, start - 12) : start].rstrip("  ")
    last = left.split()[-1].lower() if left.split() else ""
    return last.rstrip(".") in TITLES


def around(text: str, start: int, end: int, g: dict) -> list[str]:
    """The lexical patterns of a span: two tokens left, two right, one on each side."""
    word = lambda t: "#" if t.isdigit() else "¶" if t == "\n" else t.lower()
    left = [word(t) for t in g["token"].findall(text[max(0, start - 80) : start])][-2:]
    right = [word(t) for t in g["token"].findall(text[end : end + 80])][:2]
    left, right = ["^"] * (2 - len(left)) + left, right + ["$"] * (2 - len(right))
    return [f"L {' '.join(left)}", f"R {' '.join(right)}", f"M {left[-1]} _ {right[0]}"]


PROPOSED = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("kind", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("items", pa.list_(pa.string())), ("patterns", pa.list_(pa.string())), ("seed", pa.bool_())])


PROPOSED_SQL = "doc_id bigint, k bigint, kind string, start_pos int, end_pos int, items array<string>, patterns array<string>, seed boolean"


def per_text(documents: DataFrame, spans_of: Callable[[dict], Callable[[str], Iterator[tuple]]], first: int) -> DataFrame:
    """The spans (kind, start, end, items, seed) that a function gives for each text, numbered from `first`, with their patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grammars()
        of = spans_of(g)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), 200):
                rows = []
                for doc, text in zip(ids[at : at + 200], texts[at : at + 200]):
                    for k, (kind, a, b, items, seed) in enumerate(of(text or "")):
                        rows.append((doc, first + k, kind, a, b, sorted(set(items)), around(text, a, b, g), seed))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), PROPOSED)] if rows else [pa.array([], f.type) for f in PROPOSED], schema=PROPOSED)

    return spread_out(documents.select("doc_id", "text")).mapInArrow(run, PROPOSED_SQL)


def proposals(documents: DataFrame) -> DataFrame:
    """All spans that the grammars propose, with their items and patterns."""
    return per_text(documents, lambda g: lambda text: spans(text, g), 0)


def low(text: str) -> str:
    """Lower case, sign by sign, with one kind of space."""
    out = text.lower()
    return (out if len(out) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)).translate(SPACES)


SPACES = str.maketrans({c: " " for c in S[1:-1]})


def context_machine(patterns: Iterable[str]) -> Callable[[str], Iterator[tuple[int, int, set[str]]]]:
    """A function that gives (start, end, patterns) of all places of a text in lower case where the two tokens of a pattern stand."""
    import ahocorasick

    texts: dict[str, set[str]] = {}
    for pattern in patterns:
        x, y = (t.replace("¶", "\n") for t in pattern[2:].split(" "))
        for sep in ("", " "):
            texts.setdefault(x + sep + y, set()).add(pattern)
    machine = ahocorasick.Automaton()
    for t, own in texts.items():
        machine.add_word(t, (len(t), t[0].isalnum(), t[-1].isalnum(), own))
    machine.make_automaton()

    def places(text: str) -> Iterator[tuple[int, int, set[str]]]:
        for last, (size, opens, closes, own) in machine.iter(text):
            begin, end = last + 1 - size, last + 1
            if not (opens and begin and text[begin - 1].isalnum() or closes and end < len(text) and text[end].isalnum()):
                yield begin, end, own

    return places


def fired(documents: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern, hits): how often the two tokens of a pattern stand in the texts, whatever is beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = context_machine(patterns)
        for batch in batches:
            n: Counter = Counter()
            for text in batch.column(0).to_pylist():
                for _, _, own in places(low(text or "")):
                    n.update(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["pattern", "hits"])

    return spread_out(documents.select("text")).mapInArrow(run, "pattern string, hits bigint").groupBy("pattern").agg(F.sum("hits").alias("hits"))


def by_patterns(found: list[tuple[str, str]]) -> Callable[[dict], Callable[[str], Iterator[tuple]]]:
    """Spans behind left patterns (kind, 'L x y') and names before right ones (name, 'R x y') that no grammar proposes there."""

    def spans_of(g: dict) -> Callable[[str], Iterator[tuple]]:
        kinds: dict[str, set[str]] = {}
        for kind, pattern in found:
            kinds.setdefault(pattern, set()).add(kind)
        places = context_machine(kinds)
        blank = S[1:-1]

        def of(text: str) -> Iterator[tuple]:
            known, left, right = None, {}, {}
            for stop, begin, patterns in places(low(text)):
                while begin < len(text) and text[begin] in blank:
                    begin += 1
                while stop > 0 and text[stop - 1] in blank:
                    stop -= 1
                left.setdefault(begin, set()).update(patterns)
                right.setdefault(stop, set()).update(patterns)
            given = set()
            for begin, patterns in sorted(left.items()):
                if begin >= len(text) or not (text[begin].isalnum() or text[begin] in "+("):
                    continue
                own = around(text, begin, begin, g)[0]
                if own not in patterns:  # in the middle of a word, or before the span
                    continue
                if known is None:
                    known = {(s[0], s[1]) for s in spans(text, g)}
                for kind in sorted(kinds[own]):
                    if (kind, begin) in known or kind == "email":
                        continue
                    if kind == "name":
                        if text[begin].islower():
                            for s in named_at(text, begin, g["lower"], g):
                                given.add(s[1:3])
                                yield s
                    elif m := g["anything"][kind].match(text, begin):
                        yield kind, begin, m.end(), [digits_as(m[0])] if kind != "address" else address_items(m[0]), False
            for stop, patterns in sorted(right.items()):
                own = around(text, stop, stop, g)[1] if stop and text[stop - 1].isalpha() else None
                if own in patterns and "name" in kinds[own]:
                    for m in g["words"].finditer(text, max(0, stop - 80), stop, overlapped=True):
                        for s in named_at(text, m.start(), g["lower"], g) if text[m.start()].islower() else ():
                            if s[2] == stop and s[1:3] not in given:
                                given.add(s[1:3])
                                yield s

        return of

    return spans_of


def edge(kind: str, value: str) -> Column:
    return F.xxhash64(kind, value)


def spread(found: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(i, weight, edges) and (p, weight, n, edges): scores over the graph of items and patterns, each known by a hash with its kind."""
    pairs = found.select("kind", "seed", F.explode("items").alias("item"), "patterns").select("kind", "seed", edge("kind", "item").alias("i"), F.explode("patterns").alias("pattern"))
    pairs = pairs.select("seed", "i", edge("kind", "pattern").alias("p"))
    edges = scratch.keep(pairs.groupBy("i", "p").agg(F.count(F.lit(1)).alias("times"), F.max(F.col("seed").cast("int")).alias("seed")))
    items = scratch.keep(edges.groupBy("i").agg(F.max("seed").cast("double").alias("weight"), F.count(F.lit(1)).alias("edges")))
    patterns, total = items, edges.count()
    for _ in range(rounds):
        held = attach(edges.select("i", "p", "times"), items.select("i", "weight", "edges"), ["i"], "edges", total=total)
        # what isn't known to be good counts against a pattern, but less than what is counts for it
        good = F.sum(F.when(F.col("weight") >= 0.5, F.col("times") * F.col("weight")).otherwise(0.0))
        patterns = scratch.keep(held.groupBy("p").agg(good.alias("good"), F.sum("times").alias("n"), F.count(F.lit(1)).alias("edges")).withColumn("weight", F.col("good") / (F.col("good") + UNKNOWN * (F.col("n") - F.col("good")) + 0.5)))
        held = attach(edges.select("i", "p", "times"), patterns.select("p", "weight", "edges"), ["p"], "edges", total=total)
        # an item is as good as the patterns it mostly stands in
        score = F.sum(F.col("times") * F.col("weight")) / (F.sum("times") + 0.5)
        items = scratch.keep(held.groupBy("i").agg(F.least(F.lit(1.0), score * 1.25).alias("weight"), F.count(F.lit(1)).alias("edges")))
    return items, patterns


def weighed(found: DataFrame, items: DataFrame, patterns: DataFrame) -> DataFrame:
    """found with the weights of its patterns (L, R, M: struct of w, n) and the least, mean and largest of its items; unknown ones weigh 0."""
    each = found.select("doc_id", "k", "kind", F.posexplode("patterns").alias("side", "pattern")).select("doc_id", "k", "side", edge("kind", "pattern").alias("p"))
    by_pattern = attach(each, patterns.select("p", F.col("weight").alias("pw"), "n"), ["p"], "n", "left")
    of = lambda i: F.struct(F.coalesce(F.max(F.when(F.col("side") == i, F.col("pw"))), F.lit(0.0)).alias("w"), F.coalesce(F.max(F.when(F.col("side") == i, F.col("n"))), F.lit(0)).alias("n"))
    context = by_pattern.groupBy("doc_id", "k").agg(*[of(i).alias(s) for i, s in enumerate("LRM")])
    each = found.select("doc_id", "k", "kind", F.explode("items").alias("item")).select("doc_id", "k", edge("kind", "item").alias("i"))
    by_item = attach(each, items.select("i", F.col("weight").alias("iw"), "edges"), ["i"], "edges", "left").withColumn("iw", F.coalesce("iw", F.lit(0.0)))
    by_item = by_item.groupBy("doc_id", "k").agg(F.min("iw").alias("low_item"), F.avg("iw").alias("item"), F.max("iw").alias("top_item"))
    return found.join(context, ["doc_id", "k"]).join(by_item, ["doc_id", "k"])


def judged(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos, score) of the spans whose weights speak for them."""
    # a pattern counts by how often it was seen, too: once is half of what it says
    sure = lambda s: F.col(f"{s}.w") * F.col(f"{s}.n") / (F.col(f"{s}.n") + 1)
    best = F.greatest(sure("L"), sure("R"), sure("M"))
    often = F.col("L.n") / (F.col("L.n") + 2)
    # what stands left says most
    context = 0.7 * often * F.col("L.w") + (1 - 0.7 * often) * best
    refuted = ((1 - F.col("L.w")) * often >= 0.75) & (sure("R") < 0.9)
    both = 0.4 * F.greatest(sure("L"), sure("M")) + 0.4 * F.greatest(sure("R"), sure("M")) + 0.2 * F.col("item")
    known = ((best >= 0.5) & (F.col("top_item") >= 0.3) | (F.col("low_item") >= 0.6) & (best >= 0.2)) & ~refuted
    kind = F.col("kind")
    name = F.when(known, 0.5 + 0.5 * both)
    # domains, streets and towns speak for themselves where they are known; a seed needs a place that isn't foreign to its kind
    item = F.when(kind.isin("email", "address"), F.greatest(context, 0.5 * context + 0.5 * F.col("item"), F.when(best >= 0.02, F.col("low_item")))).otherwise(context)
    seed = F.when(F.col("seed") & (best >= 0.02), F.greatest(F.lit(0.7), item)).otherwise(item)
    scored = rows.withColumn("score", F.when(kind == "name", name).otherwise(seed))
    return scored.filter(F.col("score") >= least).select("doc_id", "kind", "start_pos", "end_pos", "score")


def strong_patterns(documents: DataFrame, found: DataFrame, patterns: DataFrame, scratch: Scratch) -> Iterator[list[tuple[str, str]]]:
    """Blocks of (kind, pattern): the left patterns, and the right ones of names, that may propose spans.

    Their weight is high, and of all places where they stand a share of HELD or more holds good items. Patterns with digits or at an end of
    a text can't.
    """
    good = patterns.filter(F.col("weight") * F.col("n") / (F.col("n") + 1) >= STRONG).select("p", "good")
    sides = F.when(F.col("kind") == "name", F.slice("patterns", 1, 2)).otherwise(F.slice("patterns", 1, 1))
    each = found.select("kind", F.explode(sides).alias("pattern")).filter(~F.col("pattern").rlike(r"[#^$]")).distinct()
    each = scratch.keep(each.withColumn("p", edge("kind", "pattern")).join(good, "p").select("kind", "pattern", "good"))
    block: list[dict] = []
    for row in chain(each.toLocalIterator(), [None]):  # a block at a time
        if row is not None:
            block.append(row)
        if block and (row is None or len(block) == BLOCK):
            hits = {r["pattern"]: r["hits"] for r in fired(documents, sorted({r["pattern"] for r in block})).collect()}  # at most BLOCK rows
            if some := [(r["kind"], r["pattern"]) for r in block if r["good"] >= HELD * hits.get(r["pattern"], 0)]:
                yield some
            block = []


def personal_spans(documents: DataFrame, least: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos, score)."""
    scratch = Scratch(documents.sparkSession)
    found = scratch.keep(proposals(documents))
    items, patterns = spread(found, scratch, rounds)
    every, first = found, 1 << 40
    for block in strong_patterns(documents, found, patterns, scratch):
        every, first = every.unionByName(per_text(documents, by_patterns(block), first)), first + (1 << 40)
    every = every if every is found else scratch.keep(every)
    return settled(judged(weighed(every, items, patterns), least))


def settled(scored: DataFrame) -> DataFrame:
    """Of overlapping spans of a text the best one: by kind (an email holds what looks like names), score, length, start."""
    order = F.array(*[F.lit(k) for k in ("email", "address", "id_number", "phone", "name")])
    own = F.struct(F.array_position(order, F.col("kind")).cast("int").alias("rank"), "score", "start_pos", "end_pos", "kind")
    by_text = scored.groupBy("doc_id").agg(F.collect_list(own).alias("spans"))  # a text's own spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts: list[int] = []
                ends: list[int] = []
                for r in sorted(rows, key=lambda r: (r["rank"], -r["score"], r["start_pos"] - r["end_pos"], r["start_pos"])):
                    at = bisect_right(starts, r["start_pos"])
                    if (at == 0 or ends[at - 1] <= r["start_pos"]) and (at == len(starts) or starts[at] >= r["end_pos"]):
                        starts.insert(at, r["start_pos"])
                        ends.insert(at, r["end_pos"])
                        out.append((doc, r["kind"], r["start_pos"], r["end_pos"], r["score"]))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc_id", "kind", "start_pos", "end_pos", "score"])

    return by_text.mapInArrow(run, "doc_id bigint, kind string, start_pos int, end_pos int, score double")


def redact(documents: DataFrame, found: DataFrame) -> DataFrame:
    """documents (doc_id, text) with typed placeholders, such as [EMAIL], in place of the spans."""
    by_doc = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("spans"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(s, x):  # noqa: ANN001, ANN202
        kept = F.substring(F.col("text"), s["at"] + 1, x["start_pos"] - s["at"])
        return F.struct(F.concat(s["out"], kept, F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"), x["end_pos"].alias("at"))

    done = F.aggregate(F.coalesce("spans", F.expr("cast(array() as array<struct<start_pos:int,end_pos:int,kind:string>>)")), start, put)
    return documents.join(by_doc, "doc_id", "left").withColumn("s", done).select("doc_id", F.when(F.col("text").isNotNull(), F.concat("s.out", F.expr("substring(text, s.at + 1)"))).alias("text"), F.coalesce(F.size("spans"), F.lit(0)).alias("spans"))
