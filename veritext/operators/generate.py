"""Synthetic examples at scale: every slot is a function of seed, slot and attempt, on any partitioning."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritext.functions import text as T
from veritext.functions.order import first_rows, permuted
from veritext.functions.shared import numbered, shared_path, written
from veritext.operators.forms import FIGURES, form_catalog

#: Wordings of the four kinds of statement. The first of each is a fixed value: audits look for the plain form.
STATEMENTS = {
    "A": [
        "all {S} are {P}",
        "every single one of the {S} is one of the {P}",
        "if it is one of the {S}, it is one of the {P}",
        "the {S} are, one and all, {P}",
        "to be one of the {S} is to be one of the {P}",
    ],
    "E": [
        "no {S} are {P}",
        "{S} can not be {P}",
        "if it is one of the {S}, it is not one of the {P}",
        "the {S} and the {P} have not one item in common",
        "to be one of the {S} is not to be one of the {P}",
    ],
    "I": [
        "some {S} are {P}",
        "a few {S} are {P}",
        "one or two of the {S} are {P}",
        "among the {S} there are {P}",
        "it is a fact that some of the {S} are {P}",
    ],
    "O": [
        "some {S} are not {P}",
        "a few {S} are not {P}",
        "not every one of the {S} is one of the {P}",
        "among the {S} there are some that are not {P}",
        "it is a fact that some of the {S} are not {P}",
    ],
}
#: How a conclusion begins. The first is a fixed value: audits and the stress rules look for it.
LEADS = [
    "Therefore, ",
    "So ",
    "Hence ",
    "As a result, ",
    "This shows that ",
    "We may conclude that ",
    "It is clear by now that ",
]


#: So many keys of a round's draws may be broadcast (about 25 MB).
BROADCAST_KEYS = 250_000
#: From which round on a slot tries several attempts in a round, and how many.
EARLY, TRIES = 6, 8


@dataclass(frozen=True)
class Lexicon:
    """Words to build terms from. Triples are (predicate, middle, subject), from wide to narrow where they are plausible."""

    topics: Sequence[str]
    domains: dict[str, Sequence[tuple[str, str, str]]]
    absurd: Sequence[tuple[str, str, str]]
    modifiers: Sequence[str]
    absurd_modifiers: Sequence[str]
    topic_domain: dict[str, str] = field(default_factory=dict)


def default_lexicon() -> Lexicon:
    """A small lexicon of our own; a production job brings its own words."""
    domains = {
        "garden": [("plants", "shrubs", "roses"), ("tools", "cutters", "shears"), ("birds", "songbirds", "finches"), ("meals", "soups", "broths")],
        "workshop": [("machines", "presses", "mills"), ("metals", "alloys", "brasses"), ("workers", "welders", "apprentices"), ("joints", "hinges", "pivots")],
        "harbour": [("vessels", "boats", "ferries"), ("sailors", "pilots", "helmsmen"), ("signals", "lamps", "beacons"), ("cargoes", "barrels", "kegs")],
        "library": [("texts", "books", "novels"), ("readers", "students", "novices"), ("shelves", "racks", "stands"), ("records", "lists", "ledgers")],
    }
    words = "old new small large clean bright nearby costly tidy narrow common sturdy spare varnished rented northern early plain folded trusted".split()
    odd = "yodelling transparent melting sleepwalking triangular weightless upended gossiping knitted frozen yawning square whistling ticklish inflatable sulking".split()
    absurd = [("kettles", "mayors", "glaciers"), ("walruses", "staircases", "sonnets"), ("lamps", "cousins", "deltas"), ("trombones", "radishes", "nebulas"), ("echoes", "custards", "referees"), ("doors", "meteors", "gherkins")]
    topics = [f"{d}-{k}" for d in domains for k in range(10)]
    return Lexicon(topics, domains, absurd, words, odd, {t: t.split("-")[0] for t in topics})


def strata(total: int, premise_counts: Sequence[int]) -> list[tuple[int, int, int]]:
    """(premise count, first slot, size): an even share each, the first ones one more."""
    if total < 0 or not premise_counts:
        raise ValueError("total must not be negative, premise_counts not empty")
    k, out, at = len(premise_counts), [], 0
    for i, n in enumerate(premise_counts):
        size = total // k + (i < total % k)
        out.append((n, at, size))
        at += size
    return out


def positions(n: int) -> list[tuple[int, int]]:
    """All pairs i < j below n, the latest first."""
    return sorted(combinations(range(n), 2), key=lambda p: (-p[1], -p[0]))


def plan_slots(slots: DataFrame, total: int, premise_counts: Sequence[int]) -> DataFrame:
    """``slots`` (slot) with premise_count, local, validity, plausibility, serial, i, j, topic_index: closed forms, no shuffle."""
    parts = strata(total, premise_counts)
    rows = []
    done = [0, 0, 0, 0]
    for n, at, size in parts:
        earlier = sum(r[2] for r in rows if r[0] == n)
        rows.append((n, at, size, list(done), earlier))
        done = [d + (size - c + 3) // 4 for c, d in enumerate(done)]
    pick = lambda value: _chain([(F.col("slot") < at + size, value(n, at, size, off, earlier)) for n, at, size, off, earlier in rows])
    out = slots.withColumn("premise_count", pick(lambda n, *_: F.lit(n)))
    out = out.withColumn("start", pick(lambda n, at, *_: F.lit(at)).cast("long")).withColumn("local", F.col("slot") - F.col("start"))
    out = out.withColumn("cycle", (F.col("local") % 4).cast("int"))
    offset = pick(lambda n, at, size, off, e: F.get(F.array(*map(F.lit, off)), F.col("cycle")))
    out = out.withColumn("serial", offset.cast("long") + F.floor(F.col("local") / 4))
    out = out.withColumn("validity", F.col("cycle").isin(0, 2)).withColumn("plausibility", F.col("cycle").isin(0, 1))
    turn = pick(lambda n, at, size, off, e: F.lit(e)).cast("long") + F.col("local")
    pairs = {n: positions(n) for n in set(premise_counts)}
    for c, which in (("i", 0), ("j", 1)):
        arrays = [
            (F.col("premise_count") == n, F.get(F.array(*[F.lit(p[which]) for p in ps]), (turn % len(ps)).cast("int"))) for n, ps in pairs.items()
        ]
        out = out.withColumn(c, _chain(arrays))
    return out.withColumn("topic_index", F.col("start") + 2 * F.col("local") + 1).drop("cycle", "start")


def _chain(cases: list[tuple[Column, Column]]) -> Column:
    out = F.when(*cases[0])
    for c, v in cases[1:]:
        out = out.when(c, v)
    return out


def numbers(*at: Column | str | int) -> Column:
    """Eight numbers below 2**32, n0 to n7, that depend on ``at`` alone."""
    named = [p if isinstance(p, Column) else F.lit(p) for p in at]
    return F.struct(*[F.shiftrightunsigned(F.xxhash64(*named, F.lit(k)), 32).alias(f"n{k}") for k in range(8)])


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _nth(values: Sequence[str] | Sequence[int], n: Column) -> Column:
    """The n-th of ``values``; texts without the unit separator, as one text that is cut once, are cheaper to plan than literals."""
    if isinstance(values[0], int) or any("\x1f" in v for v in values):
        return F.get(F.expr(f"array({','.join(_quoted(v) if isinstance(v, str) else str(v) for v in values)})"), n.cast("int"))
    return F.get(F.split(F.lit("\x1f".join(values)), "\x1f"), n.cast("int"))


class _Words:
    """Expressions that build terms and sentences from drawn numbers, by places in flat lists of words and of pieces of wordings."""

    def __init__(self, lex: Lexicon, style: str):
        if style not in ("canonical", "varied", "mixed"):
            raise ValueError("style is canonical, varied or mixed")
        flat = lambda words: [" ".join(w.split()) for w in words]
        triples = lambda ts: [tuple(flat(t)) for t in ts]
        lex = Lexicon(
            lex.topics, {d: triples(ts) for d, ts in lex.domains.items()}, triples(lex.absurd), flat(lex.modifiers), flat(lex.absurd_modifiers),
            lex.topic_domain,
        )
        self.lex, self.style = lex, style
        self.modifiers = [*lex.modifiers, *lex.absurd_modifiers]
        self.capitals = [m[:1].upper() + m[1:] for m in self.modifiers]
        self.sizes = len(lex.modifiers), len(lex.absurd_modifiers)
        likely = [t for ts in lex.domains.values() for t in ts]
        self.likely, self.terms = len(likely), [w for t in (*likely, *lex.absurd) for w in t]
        #: without empty words, all that is built of them has single spaces and needs no normalising
        self.clean = all(self.modifiers) and all(self.terms)
        starts, at = {}, 0
        for d, ts in lex.domains.items():
            starts[d], at = (at, len(ts)), at + len(ts)
        home = next(iter(starts))
        self.homes = [starts.get(lex.topic_domain.get(t, home), starts[home]) for t in lex.topics]
        # of the wordings of A, E, I and O, one after another, what stands before, between and behind the terms
        pieces = [re.split(r"\{S\}|\{P\}", w) for f in "AEIO" for w in STATEMENTS[f]]
        self.before, self.between, self.behind = map(list, zip(*pieces))

    def normal(self, text: Column) -> Column:
        return text if self.clean else T.normalise(text)

    def modifier_places(self, plausible: Column, m1: Column, m2: Column, shape: Column) -> tuple[Column, Column]:
        """Places of one modifier (the second is null), or of two different ones in either order."""
        n = F.when(plausible, self.sizes[0]).otherwise(self.sizes[1])
        one, two = m1 % n, m2 % (n - 1)
        two = two + F.when(two >= one, 1).otherwise(0)
        start, shape = F.when(plausible, 0).otherwise(self.sizes[0]), shape % 3
        return start + F.when(shape == 2, two).otherwise(one), F.when(shape != 0, start + F.when(shape == 2, one).otherwise(two))

    def prefix(self, plausible: Column, m1: Column, m2: Column, shape: Column) -> Column:
        a, b = self.modifier_places(plausible, m1, m2, shape)
        return F.concat_ws(" ", _nth(self.modifiers, a), _nth(self.modifiers, b))

    def topic_triple(self, plausible: Column, topic: Column, n: Column) -> Column:
        """Place of a triple: of the topic's domain, or an absurd one; ``topic`` is the topic's place."""
        home = _nth([h[0] for h in self.homes], topic) + n % _nth([h[1] for h in self.homes], topic)
        return F.when(plausible, home).otherwise(self.likely + n % len(self.lex.absurd))

    def term(self, triple: Column, role: Column | str) -> Column:
        return _nth(self.terms, triple * 3 + (F.lit("PMS".index(role)) if isinstance(role, str) else role))

    def _plain(self, n: Column) -> Column:
        return {"canonical": F.lit(True), "varied": F.lit(False), "mixed": n % 100 < 35}[self.style]

    def wording(self, form: Column, plain: Column, wording: Column) -> Column:
        """Place of a wording; ``form`` counts A, E, I and O from 0."""
        return form * 5 + F.when(self._plain(plain), 0).otherwise(wording % 5)

    def body(self, at: Column, subject: Column, predicate: Column) -> Column:
        return F.concat(_nth(self.before, at), subject, _nth(self.between, at), predicate, _nth(self.behind, at))

    def premise(self, at: Column, subject: Column, predicate: Column, capital: Column) -> Column:
        """The statement as a sentence; ``capital`` is the subject where it begins the sentence."""
        subject = F.when(_nth(self.before, at) == "", capital).otherwise(subject)
        before = [b[:1].upper() + b[1:] for b in self.before]
        return F.concat(_nth(before, at), subject, _nth(self.between, at), predicate, _nth([b + "." for b in self.behind], at))

    def conclusion(self, form: Column, subject: Column, predicate: Column, z: Column) -> Column:
        nth = F.when(self._plain(z["n2"]), 0).otherwise(z["n3"] % len(LEADS))
        return F.concat(_nth(LEADS, nth), self.body(self.wording(form, z["n0"], z["n1"]), subject, predicate), F.lit("."))

    def sentence(self, plausible: Column, n: Column) -> Column:
        """A sentence from eight drawn numbers."""
        a, b = self.modifier_places(plausible, n["n0"], n["n1"], n["n2"])
        triple = F.when(plausible, n["n3"] % self.likely).otherwise(self.likely + n["n3"] % len(self.lex.absurd))
        role = lambda roles: self.term(triple, _nth(["PMS".index(r) for r in roles], n["n4"] % 6))
        subject = lambda words: F.concat_ws(" ", _nth(words, a), _nth(self.modifiers, b), role("SSPPMM"))
        predicate = F.concat_ws(" ", _nth(self.modifiers, a), _nth(self.modifiers, b), role("PMMSPS"))
        return self.premise(self.wording(n["n5"] % 4, n["n6"], n["n7"]), subject(self.modifiers), predicate, subject(self.capitals))

    def few(self, need: Column, plausible: Column, drawn: list[Column]) -> list[Column]:
        """One sentence more than needed, the others null."""
        return [F.when(need >= t, self.sentence(plausible, n)) for t, n in enumerate(drawn)]

    def picked(self, few: list[Column], need: Column, used: Column, avoid: Column | None) -> Column:
        """The first ``need`` of the sentences that repeat nothing."""
        fit = F.array(*[F.when(self._fits(s, used, avoid), s) for s in few])
        return F.slice(F.array_except(fit, F.array(F.lit(None).cast("string"))), F.lit(1), need)

    def _fits(self, s: Column, used: Column, avoid: Column | None) -> Column:
        low = F.lower(s)
        ok = ~F.array_contains(used, low) & ~F.contains(low, F.lit(" of them "))
        # what is avoided are content words, so the sentence's other words meet none of them
        return ok if avoid is None else ok & ~F.arrays_overlap(F.regexp_extract_all(low, F.lit("[a-z][a-z'-]*"), F.lit(0)), avoid)

    def all_drawn(self, need: Column, most: int, plausible: Column, used: Column, avoid: Column | None, *at) -> Column:
        drawn = F.transform(F.transform(F.sequence(F.lit(0), F.lit(2 * most + 1)), lambda t: numbers(*at, "d", t)), lambda n: self.sentence(plausible, n))
        return F.slice(F.array_distinct(F.filter(drawn, lambda s: self._fits(s, used, avoid))), F.lit(1), need)

    def distractors(self, need: Column, most: int, plausible: Column, used: Column, avoid: Column | None, *at, few: Column | None = None) -> Column:
        """``need`` sentences that repeat nothing, be it in another case; fewer where the over-draw ran short.

        ``used`` holds lower-case sentences, ``avoid`` content words. Drawn sentences are built of single spaces, so lower case is their
        signature. The first sentences that are left are the same however many are drawn behind them, so all are drawn only where the
        first few don't do.
        """
        few = self.picked(self.few(need, plausible, _numbers_of(most + 1, *at)), need, used, avoid) if few is None else few
        return F.when(F.size(few) == need, few).otherwise(self.all_drawn(need, most, plausible, used, avoid, *at))

    def with_distractors(self, x: DataFrame, name: str, need: Column, most: int, plausible: Column, used: Column, avoid: Column | None, *at) -> DataFrame:
        """``x`` with ``distractors`` as a column; ``used`` in any case. Numbers and sentences are columns of their own before, so that none is
        made several times, each in a step with a lambda: such steps aren't fused, and all in one method would be too long to be compiled."""
        named = {"_need": need, "_used": used} | ({} if avoid is None else {"_avoid": avoid})
        x = x.withColumns(named | {"_n": F.transform(F.sequence(F.lit(0), F.lit(most)), lambda t: numbers(*at, "d", t))})
        need, avoid = F.col("_need"), None if avoid is None else F.col("_avoid")
        made = {f"_s{t}": s for t, s in enumerate(self.few(need, plausible, [F.col("_n")[t] for t in range(most + 1)]))}
        x = x.withColumns(made | {"_used": F.transform("_used", lambda s: F.lower(s))})
        x = x.withColumn("_few", self.picked(list(map(F.col, made)), need, F.col("_used"), avoid))
        x = x.withColumn(name, self.distractors(need, most, plausible, F.col("_used"), avoid, *at, few=F.col("_few")))
        return x.drop("_few", "_n", *named, *made)


def _numbers_of(n: int, *at) -> list[Column]:
    return [numbers(*at, "d", F.lit(t)) for t in range(n)]


def _assemble(x: DataFrame, w: _Words) -> DataFrame:
    """From first, second, conclusion, spare (list), i, j, premise_count: syllogism and relevant_premises. Sentences come normalised."""
    i, j = F.col("i"), F.col("j")
    # spare is named three times, so that it is made once before and not again for each place that it fills
    parts = F.concat(
        F.slice("spare", F.lit(1), i), F.array("first"), F.slice("spare", i + 1, j - i - 1), F.array("second"),
        F.slice("spare", j, F.greatest(F.size("spare") - j + 1, F.lit(0))), F.array("conclusion"),
    )
    pair = F.array("i", "j")
    x = x.withColumn("syllogism", w.normal(F.array_join(parts, " ")))
    return x.withColumn("relevant_premises", F.when(F.col("validity"), pair).otherwise(F.array().cast("array<int>")))


def _draw_cores(slots: DataFrame, catalog: DataFrame, sizes: dict[bool, int], w: _Words, seed: str) -> DataFrame:
    """``slots`` (plan_slots and attempt) with form, topic, major, minor, conclusion and core_signature: one attempt for each row."""
    at = (seed, F.col("slot"), F.col("attempt"))
    plausible = F.col("plausibility")
    size = F.when(F.col("validity"), sizes[True]).otherwise(sizes[False])
    x = slots.withColumn("_nth", (F.col("serial") % size).cast("int"))
    x = x.join(F.broadcast(catalog.select(F.col("valid").alias("validity"), F.col("nth").alias("_nth"), "figure", "mood", "name", "fallacy")), ["validity", "_nth"])
    topic = F.col("topic_index") % len(w.lex.topics)
    # steps with a lambda aren't fused with their neighbours: all steps in one method are too long to be compiled
    x = x.withColumn("_d", F.transform(F.array(F.lit("core"), F.lit("conclusion")), lambda part: numbers(*at, part)))
    x = x.withColumn("topic", _nth(w.lex.topics, topic)).withColumns({"_z": F.col("_d")[0], "_y": F.col("_d")[1]})
    z = F.col("_z")
    x = x.withColumn("_t", w.topic_triple(plausible, topic, z["n3"])).withColumn("_p", w.prefix(plausible, z["n0"], z["n1"], z["n2"]))
    x = x.withColumns({"_" + r.lower() * 2: F.concat_ws(" ", "_p", w.term(F.col("_t"), r)) for r in "SPM"})
    term = lambda k: _chain([(F.col("figure") == f, F.col("_" + roles[k].lower() * 2)) for f, roles in FIGURES.items()])
    form = lambda k: F.instr(F.lit("AEIO"), F.substring("mood", k, 1)) - 1
    said = lambda k, *n: F.struct(w.wording(form(k), *n).alias("w"), term(2 * k - 2).alias("s"), term(2 * k - 1).alias("p"))
    x = x.withColumn("_said", F.array(said(1, z["n4"], z["n5"]), said(2, z["n6"], z["n7"])))
    x = x.withColumns({
        "_premises": F.transform("_said", lambda p: w.premise(p["w"], p["s"], p["p"], T.capitalise(p["s"]))),
        "conclusion": w.conclusion(form(3), F.col("_ss"), F.col("_pp"), F.col("_y")),
    })
    x = x.withColumns({"major": F.col("_premises")[0], "minor": F.col("_premises")[1]})
    return x.withColumn("core_signature", F.lower(w.normal(F.concat_ws(" ", "major", "minor", "conclusion"))))


def _draw_examples(slots: DataFrame, catalog: DataFrame, sizes: dict[bool, int], w: _Words, seed: str, most: int, semantics: str) -> DataFrame:
    """One attempt for each row of ``slots`` (plan_slots and attempt), with c and t: what must differ between examples, as 64-bit
    hashes. Two that agree by chance draw again, which changes no promise."""
    at = (seed, F.col("slot"), F.col("attempt"))
    x = _draw_cores(slots, catalog, sizes, w, seed)
    x = w.with_distractors(x, "spare", F.col("premise_count") - 2, most, F.col("plausibility"), F.array("major", "minor"), None, *at)
    x = x.withColumn("_swap", F.col("_y")["n4"] % 2 == 1).withColumn("first", F.when(F.col("_swap"), F.col("minor")).otherwise(F.col("major")))
    x = _assemble(x.withColumn("second", F.when(F.col("_swap"), F.col("major")).otherwise(F.col("minor"))), w)
    meta = F.struct(
        F.lit("synthetic").alias("source"), F.lit(semantics).alias("semantics"), F.lit(w.style).alias("style"), F.col("name").alias("schema_name"),
        "figure", "mood", "fallacy", F.array("i", "j").alias("candidate_premises"), "core_signature", F.array("major", "minor").alias("core_premises"),
        F.when(F.col("_swap"), "minor_major").otherwise("major_minor").alias("core_premise_order_in_output"), F.col("conclusion").alias("core_conclusion"),
        "topic", "premise_count", F.lit(None).cast("string").alias("base_id"), F.lit(None).cast("int").alias("num_injected_distractors"),
    )
    return x.select(
        "slot", F.sha2(w.normal(F.col("syllogism")), 256).alias("id"), "syllogism", "validity", "plausibility", "relevant_premises", meta.alias("metadata"),
        (F.size("spare") == F.col("premise_count") - 2).alias("whole"), F.xxhash64("core_signature").alias("c"), F.xxhash64(F.lower("syllogism")).alias("t"),
    )


def generate(
    slots: DataFrame,
    total: int,
    premise_counts: Sequence[int] = (5, 6, 7),
    seed: str = "42",
    semantics: str = "aristotelian",
    figures: Iterable[int] = (1, 2, 3),
    style: str = "mixed",
    lexicon: Lexicon | None = None,
    rounds: int = 30,
    taken: DataFrame | None = None,
) -> DataFrame:
    """Examples (slot, id, syllogism, validity, plausibility, relevant_premises, metadata), no two with one core or one text.

    ``taken`` has further texts in a column syllogism, which no example may repeat.

    ``slots`` holds the numbers 0 to total - 1 in a column slot. Cores are drawn first, alone: in a round the lowest of the
    slots that share one keeps it, if no earlier round has it, and the others draw again with the next attempt; from round
    ``EARLY`` on, when most of what is left has few cores to find, each tries ``TRIES`` attempts in a round and takes its first
    free one. Then each example is made, once, and its text looked at; slots whose texts don't do draw again. Cores and texts
    kept so far, and texts of ``taken``, are looked for by 64-bit hashes; examples aren't moved. More than ``rounds`` rounds
    mean that the lexicon is too small for ``total`` and are an error. A slot keeps its form and its positions in every attempt.
    """
    if any(n < 2 for n in premise_counts):
        raise ValueError("an example has two premises at least")
    spark = slots.sparkSession
    catalog = written(form_catalog(spark, semantics, figures), "forms")
    sizes = {r.valid: r["count"] for r in catalog.groupBy("valid").count().collect()}  # two rows
    w = _Words(lexicon or default_lexicon(), style)
    # slots are a few bytes each but cost much to fill, so they are dealt by number, not by size
    planned = lambda x, n: plan_slots(x.repartition(1 + n // 20_000), total, premise_counts)
    pending, rows, done = slots.select(F.col("slot").cast("long").alias("slot")), total, 0
    kept: DataFrame | None = None
    texts = None
    if taken is not None:
        texts = written(taken.select(F.xxhash64(T.signature(F.col("syllogism"))).alias("t")), "taken")
    attempt = 0
    while done < rounds:
        asked, settled = rows, None
        cores_seen = None if kept is None else kept.select("c")
        while rows and done < rounds:
            tries = TRIES if done >= EARLY else 1
            drawn = pending.withColumn("attempt", F.explode(F.sequence(F.lit(attempt), F.lit(attempt + tries - 1))))
            cores = _draw_cores(planned(drawn, rows * tries), catalog, sizes, w, seed).select("slot", "attempt", F.xxhash64("core_signature").alias("c"))
            if cores_seen is not None:
                cores = written(cores, "cores")
                cores = cores.join(_met(cores_seen, cores.select("c"), "c", rows * tries), "c", "left_anti")
            if tries > 1:
                cores = cores.groupBy("slot").agg(F.min(F.struct("attempt", "c")).alias("a")).select("slot", "a.attempt", "a.c")
            won = written(cores.groupBy("c").agg(F.min(F.struct("slot", "attempt")).alias("a")).select("a.slot", "a.attempt", "c"), "won")
            cores_seen = won.select("c") if cores_seen is None else cores_seen.union(won.select("c"))
            settled = won.drop("c") if settled is None else settled.union(won.drop("c"))
            pending = written(pending.join(won.select("slot"), "slot", "left_anti"), "lost")
            rows, attempt, done = pending.count(), attempt + tries, done + 1
        if rows:
            break
        if not asked:
            settled = pending.withColumn("attempt", F.lit(0))
        new = written(_draw_examples(planned(settled, asked), catalog, sizes, w, seed, max(premise_counts) - 2, semantics), "drawn")
        again = new.filter("whole").groupBy("t").agg(F.count("*").alias("n"), F.min("slot").alias("_first")).filter("n > 1").select("t", "_first")
        bad = new.filter("not whole").select("slot").union(new.filter("whole").join(again, "t").filter("slot > _first").select("slot"))
        if texts is not None:
            bad = bad.union(new.join(_met(texts, new.select("t"), "t", asked), "t", "left_semi").select("slot"))
        pending = written(bad.distinct(), "unfit")
        rows = pending.count()
        good = new.join(pending, "slot", "left_anti") if rows else new
        kept = good if kept is None else kept.unionByName(good)
        if not rows:
            return kept.drop("whole", "c", "t")
        texts = good.select("t") if texts is None else texts.union(good.select("t"))
    raise RuntimeError(f"no {total} different examples after {rounds} rounds: the lexicon is too small")


def _met(seen: DataFrame, asked: DataFrame, key: str, most: int) -> DataFrame:
    """Which of the keys ``asked`` (``most`` at most) are among those seen.

    Up to ``BROADCAST_KEYS`` of them are sent to where the keys seen so far lie, so that those aren't moved; beyond, both
    sides are shuffled by eight bytes.
    """
    return seen.join(F.broadcast(asked) if most <= BROADCAST_KEYS else asked, key, "left_semi").distinct()


def _firsts(keys: DataFrame) -> DataFrame:
    """(slot, t): of the rows of one round the first of each text."""
    return keys.groupBy("t").agg(F.min("slot").alias("slot")).select("slot", "t")


def _unseen(keys: DataFrame, seen: DataFrame | None, most: int) -> DataFrame:
    """``keys`` (slot, t) whose t isn't among those of ``seen``."""
    if seen is None:
        return keys
    keys = written(keys, "firsts")
    return keys.join(_met(seen, keys.select("t"), "t", most), "t", "left_anti").select("slot", "t")


def generate_like(df: DataFrame, key: str, **options) -> DataFrame:
    """As many examples as ``df`` has rows; a row's slot is its number by a hash of ``key``."""
    slots = written(numbered(df.select(key), F.col(key)).select("slot"), "slots")
    return generate(slots, slots.count(), **options)


def inject(
    base: DataFrame,
    count: int | None = None,
    premise_counts: Sequence[int] = (5, 6, 7),
    seed: str = "42",
    style: str = "mixed",
    lexicon: Lexicon | None = None,
    rounds: int = 30,
) -> DataFrame:
    """Examples of base rows (base_index, id, syllogism, validity, plausibility) with distractors put between their premises.

    Only rows of exactly three sentences with a validity are used; others are left out before the
    ranking. Base rows come in the order of a seeded hash and are repeated until ``count`` is met
    (default: each once). Labels stay. Distractors share no content word with their row. A row that
    is short of distractors keeps those it has and draws more; if some are missing after ``rounds``
    rounds (about 2,000 candidates), the lexicon is too small for that row, which is an error.
    """
    w = _Words(lexicon or default_lexicon(), style)
    b = base.withColumn("parts", T.sentences(F.col("syllogism"))).filter("size(parts) = 3 and validity is not null")
    b = written(numbered(b, F.concat_ws(":", F.lit(seed), F.col("base_index").cast("string")), "rank"), "base")
    n = b.count()
    if not n:
        return _injected(b.withColumn("slot", F.col("rank")), w, seed, premise_counts, rounds)
    slots = b.sparkSession.range(n if count is None else count).select(F.col("id").alias("slot"), (F.col("id") % n).alias("rank"))
    return _injected(slots.join(b, "rank"), w, seed, premise_counts, rounds)


def _with_distractors(x: DataFrame, w: _Words, seed: str, most: int, rounds: int) -> DataFrame:
    """``x`` with spare, premise_count - 2 distractors for each row; rows that are short draw again, wider, and only they."""
    plausible = F.coalesce("plausibility", F.lit(True))
    need = F.col("premise_count") - 2
    used = F.concat(F.slice("parts", 1, 2), F.col("spare"))
    kept: DataFrame | None = None
    x = x.withColumn("spare", F.array().cast("array<string>"))
    for attempt in range(rounds):
        at = (seed, F.col("slot"), f"inject:{attempt}" if attempt else "inject")
        if attempt:
            x = x.withColumns({"_used": F.transform(used, lambda s: F.lower(s)), "_avoid": T.content_words(F.col("syllogism"))})
            more = w.all_drawn(need - F.size("spare"), most + 33, plausible, F.col("_used"), F.col("_avoid"), *at)
            x = x.withColumn("spare", F.concat("spare", more)).drop("_used", "_avoid")
        else:
            x = w.with_distractors(x, "spare", need, most, plausible, used, T.content_words(F.col("syllogism")), *at)
        x = written(x, "injected")
        whole = x.filter(F.size("spare") == need)
        kept = whole if kept is None else kept.unionByName(whole)
        x = x.filter(F.size("spare") < need)
        if x.isEmpty():
            return kept
    raise RuntimeError(f"rows without enough distractors after {rounds} rounds: the lexicon is too small for them")


def _injected(x: DataFrame, w: _Words, seed: str, premise_counts: Sequence[int], rounds: int) -> DataFrame:
    k = len(premise_counts)
    x = x.withColumn("premise_count", F.get(F.array(*map(F.lit, premise_counts)), (F.col("slot") % k).cast("int")))
    turn = F.floor(F.col("slot") / k)
    for c, which in (("i", 0), ("j", 1)):
        x = x.withColumn(c, _chain([(F.col("premise_count") == n, F.get(F.array(*[F.lit(p[which]) for p in positions(n)]), (turn % len(positions(n))).cast("int"))) for n in set(premise_counts)]))
    parts = F.col("parts")
    kept: DataFrame | None = None
    seen: DataFrame | None = None
    pending = x
    for attempt in range(rounds):
        again = f"{seed}+{attempt}" if attempt else seed
        new = _with_distractors(pending, w, again, max(premise_counts) - 2, rounds)
        new = new.withColumn("_swap", T.draw(2, again, F.col("slot"), F.lit("inject"), "swap") == 1).withColumn("base_syllogism", F.col("syllogism"))
        new = new.withColumn("first", F.when(F.col("_swap"), parts[1]).otherwise(parts[0])).withColumn("second", F.when(F.col("_swap"), parts[0]).otherwise(parts[1]))
        new = written(_assemble(new.withColumn("conclusion", parts[2]), w), "joined")
        # of equal texts the one kept already, or the lowest slot, stays; the others draw again
        keys = new.select("slot", F.xxhash64(F.lower("syllogism")).alias("t"))
        won = written(_unseen(_firsts(keys), seen, new.count()), "won")
        seen = won.select("t") if seen is None else seen.union(won.select("t"))
        good = new.join(won.select("slot"), "slot", "left_semi")
        kept = good if kept is None else kept.unionByName(good)
        pending = written(pending.join(won.select("slot"), "slot", "left_anti"), "again")
        if pending.isEmpty():
            break
    else:
        raise RuntimeError(f"texts still repeat after {rounds} rounds: the lexicon is too small")
    return kept.select(
        "slot", T.content_id(F.col("syllogism")).alias("new_id"), "syllogism", "validity", "plausibility", "relevant_premises",
        F.coalesce("id", T.content_id(F.col("base_syllogism"))).alias("base_id"), "base_index", "base_syllogism",
        T.signature(F.col("base_syllogism")).alias("core_signature"), F.array("first", "second").alias("core_premises"), "conclusion", "i", "j",
        "premise_count", (F.col("premise_count") - 2).alias("num_injected_distractors"),
        F.when(F.col("_swap"), "minor_major").otherwise("major_minor").alias("core_order"),
    )


def injected_examples(injected: DataFrame, style: str = "mixed") -> DataFrame:
    """Rows of ``inject`` in the layout of ``generate``; plausibility that is null counts as true."""
    none = lambda kind: F.lit(None).cast(kind)
    meta = F.struct(
        F.lit("base").alias("source"), none("string").alias("semantics"), F.lit(style).alias("style"), none("string").alias("schema_name"),
        none("int").alias("figure"), none("string").alias("mood"), none("string").alias("fallacy"), F.array("i", "j").alias("candidate_premises"),
        "core_signature", "core_premises", F.col("core_order").alias("core_premise_order_in_output"), F.col("conclusion").alias("core_conclusion"),
        none("string").alias("topic"), "premise_count", "base_id", F.col("num_injected_distractors").cast("int").alias("num_injected_distractors"),
    )
    return injected.select(
        "slot", F.col("new_id").alias("id"), "syllogism", "validity", F.coalesce("plausibility", F.lit(True)).alias("plausibility"), "relevant_premises",
        meta.alias("metadata"),
    )


def generate_dataset(
    spark: SparkSession,
    count: int,
    premise_counts: Sequence[int] = (5, 6, 7),
    seed: str = "42",
    semantics: str = "aristotelian",
    figures: Iterable[int] = (1, 2, 3),
    style: str = "mixed",
    mode: str = "synthetic",
    base: DataFrame | None = None,
    ratio: float = 0.5,
    lexicon: Lexicon | None = None,
) -> DataFrame:
    """A whole dataset in the layout of ``generate``: drawn, made unique, and checked while it is written (see ``publish``).

    ``mode`` is ``synthetic``, ``base`` (distractors put into the rows of ``base``, see ``inject``) or
    ``mixed``: round(count * ratio) rows from base, halves to even, and the rest synthetic. No text
    occurs twice over both parts. Rows that break a rule are an error, as are arguments out of range.
    ``public`` gives the published columns, ``shuffled`` an order.
    """
    from veritext.operators import rules

    if mode not in ("synthetic", "base", "mixed"):
        raise ValueError("mode is synthetic, base or mixed")
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must lie between 0 and 1")
    if mode != "synthetic" and base is None:
        raise ValueError(f"mode {mode} needs base rows")
    if any(n < 2 for n in premise_counts):
        raise ValueError("an example has two premises at least")
    from_base = {"synthetic": 0, "base": count, "mixed": round(count * ratio)}[mode]
    parts = []
    if from_base:
        old = injected_examples(inject(base, from_base, premise_counts, seed, style, lexicon), style)
        parts.append(written(old, "from-base"))
        if parts[0].count() < from_base:
            raise ValueError("no base row has exactly three sentences and a validity")
    if count > from_base:
        total = count - from_base
        slots = spark.range(total).withColumnRenamed("id", "slot")
        new = generate(slots, total, premise_counts, seed, semantics, figures, style, lexicon, taken=parts[0] if parts else None)
        parts.append(written(new.withColumn("slot", F.col("slot") + from_base), "synthetic"))
    if not parts:
        return generate(spark.range(0).withColumnRenamed("id", "slot"), 0, premise_counts, seed, semantics, figures, style, lexicon)
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    path = shared_path(spark, "dataset")
    rules.publish(rules.mark_examples(out, F.col("slot"), semantics, figures), path)
    return spark.read.schema(out.schema).parquet(path)


def mix_by_ratio(base: DataFrame, synthetic: DataFrame, count: int, ratio: float, order_base: Column, order_synthetic: Column) -> DataFrame:
    """The first round(count * ratio) base rows (halves to even) and as many synthetic ones as are missing.

    The orders should be unique. Both parts are filters by the key of their last row, see ``first_rows``.
    """
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must lie between 0 and 1")
    k = round(count * ratio)
    return first_rows(base, k, order_base).unionByName(first_rows(synthetic, count - k, order_synthetic), allowMissingColumns=True)


def shuffled(df: DataFrame, id_col: str, seed: str, number: Column | None = None, place: str | None = None) -> DataFrame:
    """Rows in the order of a keyed permutation: each row's place follows from its number and the seed alone.

    ``number`` counts the rows from 0 without gaps; by default ids (unique) are numbered. Rows are dealt by ranges of
    places and lie in order in each partition; ``place`` names a column that keeps the place.
    """
    name = place or "_place"
    rows = numbered(df, F.col(id_col), "_number") if number is None else df.withColumn("_number", number)
    rows = rows.withColumn(name, permuted(F.col("_number"), df.count(), seed)).drop("_number")
    out = rows.repartitionByRange(F.col(name)).sortWithinPartitions(name)
    return out if place else out.drop(name)


def public(df: DataFrame, metadata: bool = False, ids: bool = True) -> DataFrame:
    """The published columns: without metadata unless asked for, without ids if not wanted."""
    drop = ([] if metadata else ["metadata"]) + ([] if ids else ["id"]) + ["slot"]
    return df.drop(*drop)
