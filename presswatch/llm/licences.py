"""Licence scans by a positional index of rare template words, with built-in functions only.

Words: A-Z lower-cased, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` (digits, lower-case letters and
non-ASCII characters), numbered from 0. Base: the places where the words of a base phrase stand one after the
other. The method adds labels from templates of licence notices:

1. The index: each template word with its positions in its template. Document frequencies of the template
   words are counted over all documents (one aggregation whose result has at most one row per template word,
   so it is the only thing that reaches the driver); rarer words rank first, ties by the word.
2. In a document, the anchors of a template are its ``ANCHORS`` rarest words that the document has. Each place
   of an anchor, minus each place of that word in the template, votes for an offset (where the template would
   start). An offset is a candidate when two anchor places agree on it, or, with a single anchor word, when
   it has one.
3. A candidate is verified when every mandatory key phrase of the template stands at its place relative to
   the offset; its coverage is the share of template words found at their places. A template is named when a
   verified candidate covers ``MIN_COVERAGE`` of it. The score is the best coverage of a verified candidate of
   any template (0 without one).

All of it is one projection of each row (higher-order functions over the word array), so no text is shuffled.

Defined cases: a null text is empty: no words, no places (first and last word null), empty labels, score 0;
texts of any length are read whole; repeated rows give equal results; other columns are kept, but a column
whose name is one of the result's (compared without case) is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswatch.llm.common import fresh

# Fixed values of the contract: the base phrases and their labels, and the word pattern.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Templates of licence notices (label, notice words, mandatory key phrases), in the usual wording of each notice.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     ("permission is hereby granted",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ("redistribution and use in source and binary forms",)),
)
ANCHORS = 3
MIN_COVERAGE = 0.5
RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; a null text has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), 0)


def vocabulary() -> list[str]:
    """Every word of the templates and the base phrases, sorted."""
    words = {w for _, notice, _ in TEMPLATES for w in notice.split()}
    return sorted(words | {w for phrase, _ in BASE_PHRASES for w in phrase.split()})


def rarity(docs: DataFrame, text: str = "text") -> list[str]:
    """Template words from the rarest to the commonest: by document frequency over all documents, then word."""
    vocab = F.array(*[F.lit(w) for w in vocabulary()])
    present = F.array_intersect(words_of(F.col(text)), vocab)  # distinct, by a hash set: no lambda per word
    counts = dict(docs.select(F.explode(present).alias("word")).groupBy("word").count().collect())
    return sorted(vocabulary(), key=lambda w: (counts.get(w, 0), w))


def _phrase_at(words: Column, phrase: str, place: Column) -> Column:
    hits = [F.get(words, place + i) == F.lit(w) for i, w in enumerate(phrase.split())]
    out = hits[0]
    for hit in hits[1:]:
        out = out & hit
    return F.coalesce(out, F.lit(False))


def _starts(words: Column, phrase: str):
    """A predicate on a place: the phrase begins there."""
    return lambda i: _phrase_at(words, phrase, i)


def _template_steps(words: Column, places: Column, order: list[str], notice: str, keys: tuple[str, ...]) -> list:
    """Column makers of one template, each step on the columns of the one before (named by the caller).

    Steps: anchors; votes (sorted offsets); candidates; best coverage of a verified candidate, or null.
    """
    notice_words = notice.split()
    spots: dict[str, list[int]] = {}
    for i, w in enumerate(notice_words):
        spots.setdefault(w, []).append(i)
    ranked = [w for w in order if w in spots]
    spot_map = F.create_map(*[x for w, s in spots.items() for x in (F.lit(w), F.array(*[F.lit(i) for i in s]))])
    key_spots = [(_find(notice_words, k.split()), k) for k in keys]

    def anchors(_: dict) -> Column:
        present = F.array_distinct(F.transform(places, lambda i: F.get(words, i)))
        return F.slice(F.filter(F.array(*[F.lit(w) for w in ranked]), lambda w: F.array_contains(present, w)), 1,
                       ANCHORS)

    def votes(c: dict) -> Column:
        return F.array_sort(F.flatten(F.transform(
            F.filter(places, lambda i: F.array_contains(c["anchors"], F.get(words, i))),
            lambda i: F.transform(F.element_at(spot_map, F.get(words, i)), lambda s: i - s))))

    def candidates(c: dict) -> Column:
        v = c["votes"]
        pairs = F.filter(F.sequence(F.lit(1), F.greatest(F.size(v) - 1, F.lit(1))),
                         lambda j: (j < F.size(v)) & (F.get(v, j) == F.get(v, j - 1)))
        agreed = F.array_distinct(F.transform(pairs, lambda j: F.get(v, j)))
        return F.when(F.size(c["anchors"]) <= 1, F.array_distinct(v)).otherwise(agreed)

    def verified(o: Column) -> Column:
        out = F.lit(True)
        for start, phrase in key_spots:
            out = out & _phrase_at(words, phrase, o + start)
        return out

    def cover(o: Column) -> Column:
        found = [F.coalesce(F.get(words, o + i) == F.lit(w), F.lit(False)).cast("int") for i, w in enumerate(notice_words)]
        total = found[0]
        for f in found[1:]:
            total = total + f
        return total / F.lit(float(len(notice_words)))

    def best(c: dict) -> Column:
        return F.array_max(F.transform(F.filter(c["candidates"], verified), cover))

    return [("anchors", anchors), ("votes", votes), ("candidates", candidates), ("cover", best)]


def _find(words: list[str], phrase: list[str]) -> int:
    for i in range(len(words) - len(phrase) + 1):
        if words[i:i + len(phrase)] == phrase:
            return i
    raise ValueError(f"key phrase {' '.join(phrase)!r} is not in its template")


def licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of RESULT: word count, base places, labels and the method's score."""
    order = rarity(docs, text)
    vocab = F.array(*[F.lit(w) for w in vocabulary()])
    words, places = fresh("words", docs), fresh("places", docs)
    # Places are needed only where every word of some key phrase or base phrase occurs: elsewhere no template
    # can be verified and no base place exists. The test is a hash set per text, not a lambda per word.
    needed = {w for _, _, keys in TEMPLATES for w in " ".join(keys).split()}
    needed |= {w for phrase, _ in BASE_PHRASES for w in phrase.split()}
    have = F.array_intersect(F.col(words), F.array(*[F.lit(w) for w in sorted(needed)]))
    gates = [F.size(F.array_intersect(have, F.array(*[F.lit(w) for w in sorted(set(p.split()))]))) == len(set(p.split()))
             for p in sorted({k for _, _, keys in TEMPLATES for k in keys} | {ph for ph, _ in BASE_PHRASES})]
    any_gate = gates[0]
    for gate in gates[1:]:
        any_gate = any_gate | gate
    staged = docs.withColumn(words, words_of(F.col(text))).withColumn(places, F.when(any_gate, F.filter(
        F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(vocab, F.get(F.col(words), i))))
        .otherwise(F.array().cast("array<int>")))
    w, p = F.col(words), F.col(places)
    base_places = [(label, F.filter(p, _starts(w, phrase))) for phrase, label in BASE_PHRASES]
    every = F.array_sort(F.flatten(F.array(*[pl for _, pl in base_places])))
    base_labels = F.array_sort(F.array_distinct(F.filter(
        F.array(*[F.when(F.size(pl) > 0, F.lit(label)) for label, pl in base_places]), lambda x: x.isNotNull())))
    steps = [_template_steps(w, p, order, notice, keys) for _, notice, keys in TEMPLATES]
    names = [{step: fresh(f"t{k}_{step}", docs) for step, _ in template} for k, template in enumerate(steps)]
    for depth in range(4):
        # One projection per step: a step's column is made once and read by the next as a column.
        staged = staged.withColumns({
            names[k][template[depth][0]]: template[depth][1]({s: F.col(n) for s, n in names[k].items()})
            for k, template in enumerate(steps)})
    covers = [(label, F.col(names[k]["cover"])) for k, (label, _, _) in enumerate(TEMPLATES)]
    named = F.filter(F.array(*[F.when(c >= MIN_COVERAGE, F.lit(label)) for label, c in covers]), lambda x: x.isNotNull())
    score = F.coalesce(F.array_max(F.filter(F.array(*[c for _, c in covers]), lambda x: x.isNotNull())), F.lit(0.0))
    result = {
        "n_words": F.size(w).cast("long"),
        "n_base": F.size(every).cast("long"),
        "first_word": F.array_min(every).cast("long"),
        "last_word": F.array_max(every).cast("long"),
        "base_labels": F.array_join(base_labels, ","),
        "labels": F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, named))), ","),
        "score": score.cast("double"),
    }
    kept = [c for c in docs.columns if c.lower() not in {r.lower() for r in RESULT}]
    return staged.select(*kept, *[v.alias(k) for k, v in result.items()])
