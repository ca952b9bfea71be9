"""Language of documents by hyperdimensional profiles.

Method: every letter has a random vector of +1 and -1.  The vector of three
letters in a row binds (multiplies) the first letter's vector permuted twice,
the second's permuted once and the third's.  A document bundles (adds) the
vectors of its trigrams, a language bundles its training documents, and a
document gets the language of the prototype with the greatest cosine.  What all
languages share is taken off the prototypes first: their mean.

Counts of trigrams over all training documents are bundled where they are, in
the tasks; the driver gets one sum of DIMENSIONS numbers for each language.

Whether a text is in a learnt language at all is told by its trigrams' mean
product with the prototype as it is before the mean is taken off: near 0 for
other letters' order, near the training texts' own mean for that language.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from codequarry.llm.textkit import _ODD, blocks, mix, pieces
from codequarry.llm.workspace import Table, extended

#: Letters that trigrams of plain numbers are made of.
CODES = 64
DIMENSIONS = 1024
#: Text taken at once; some 80 bytes of arrays stand for each of its bytes.
BLOCK_BYTES = 1 << 18
#: Different trigrams that a task counts at most before it hands them on.
COUNTED = 300_000
#: Vectors of trigrams that a task keeps at most, and how many it adds up at once.
VECTORS, AT_ONCE = 24_000, 4096
#: A text is familiar if its trigrams' mean product with its language is this share of the training texts' at least,
FAMILIAR = 0.25
#: or so many standard errors below the training texts' at most, over its different trigrams: few tell little.
ERRORS = 3
#: Products are rounded to this part of one for their spread, whose sums are then exact.
FINE = 1 << 10
_PLANE, _BITS = 1 << 16, 21


def letters(data):
    """Code points of UTF-8 bytes, lower-cased where the two alphabets' places allow it, and each one's first byte.

    Code 0 stands for anything that is not a letter.
    """
    first = np.flatnonzero((data & 0xC0) != 0x80)
    b = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.int32)
    lead = b[first]
    one, two, three = b[first + 1] & 63, b[first + 2] & 63, b[first + 3] & 63
    point = np.where(lead < 0x80, lead, np.where(lead < 0xE0, (lead & 31) << 6 | one, np.where(lead < 0xF0, (lead & 15) << 12 | one << 6 | two, (lead & 7) << 18 | one << 12 | two << 6 | three)))
    point = np.where((point >= 65) & (point <= 90) | (point >= 0xC0) & (point <= 0xDE) & (point != 0xD7), point + 32, point)
    return point, first


def letter_table():
    """The lower case of each letter (Unicode's alphabetic categories) below 2**16, 0 for other characters."""
    out = np.zeros(_PLANE, dtype=np.int32)
    for c in range(_PLANE):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def folded(points, known):
    """Code points to letters in lower case, 0 for what is no letter."""
    out = known[np.minimum(points, _PLANE - 1)]
    for k in np.flatnonzero(points >= _PLANE).tolist():
        x = chr(points[k])
        out[k] = ord(x.lower()) if x.isalpha() else 0
    return out


def _counts(data, offsets, known, lead=0):
    """(document, trigram, number) of a block, in that order, and its last letter.

    A trigram is a number of three letters; a run of other characters is one
    space (0), and a document begins and ends with one.  lead: a letter with a
    space after it that stand before the block's one document.
    """
    docs = len(offsets) - 1
    point, first = letters(data)
    ends = np.searchsorted(first, offsets[1:])
    code = np.insert(folded(point, known), ends, 0)
    doc = np.repeat(np.arange(docs), np.diff(np.append(0, ends)) + 1)
    keep = code > 0
    keep[1:] |= code[:-1] > 0
    code, doc = code[keep], doc[keep]
    last = int(code[-2]) if len(code) > 1 else lead
    code = np.concatenate([np.array([lead, 0] if lead else [0], dtype=code.dtype), code])
    doc = np.concatenate([np.array([-1, 0] if lead else [-1], dtype=doc.dtype), doc])
    if len(code) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), last
    if code.max() < _PLANE:  # letters by their place among those of the block
        own = np.zeros(_PLANE, dtype=np.int64)
        own[code] = 1
        own[0] = 1
        alphabet = np.flatnonzero(own)
        own[alphabet] = np.arange(len(alphabet))
        place = own[code]
    else:
        alphabet, place = np.unique(np.append(code, 0), return_inverse=True)
        place = place[:-1]
    n = len(alphabet)
    same = doc[1:-1] == doc[2:]
    key = np.sort((((doc[2:] * n + place[:-2]) * n + place[1:-1]) * n + place[2:])[same])
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    number, key = np.diff(np.append(new, len(key))), key[new]
    a, b, c = (alphabet[x].astype(np.int64) for x in (key // (n * n) % n, key // n % n, key % n))
    return key // (n * n * n), a << 2 * _BITS | b << _BITS | c, number, last


def trigram_counts(data, offsets, known):
    """As _counts, a very long text piece by piece."""
    cuts = pieces(data, BLOCK_BYTES) if len(offsets) == 2 else [len(data)]
    if len(cuts) == 1:
        return _counts(data, offsets, known)[:3]
    grams, numbers, lead = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
        _, gram, number, lead = _counts(data[a:b], np.array([0, b - a]), known, lead)
        grams, numbers = summed(np.concatenate([grams, gram]), np.concatenate([numbers, number]))
    return np.zeros(len(grams), dtype=np.int64), grams, numbers


def summed(grams, numbers):
    """Different trigrams, rising, and the sums of their numbers."""
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    new = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, dtype=np.int64)
    return grams[new], np.add.reduceat(numbers[order], new) if len(new) else numbers


def letter_vectors(points):
    """A random vector of +1 and -1 for each letter, made of its code point alone."""
    words = DIMENSIONS // 64
    with np.errstate(over="ignore"):
        bits = mix(mix(points.astype(np.uint64) + np.uint64(0x1A46))[:, None] + np.arange(1, words + 1, dtype=np.uint64) * _ODD)
    return (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def gram_vectors(grams, codes=CODES):
    """Vectors of trigrams (numbers of three letters, `codes` to a place): bound, permuted letter vectors."""
    alphabet, place = np.unique(np.stack([grams // codes // codes, grams // codes % codes, grams % codes]), return_inverse=True)
    a, b, c = place.reshape(3, -1)
    letter = letter_vectors(alphabet)
    return np.roll(letter, 2, axis=1)[a] * np.roll(letter, 1, axis=1)[b] * letter[c]


def bundled(grams, numbers):
    """The sum of the vectors of trigrams, each so many times."""
    total = np.zeros(DIMENSIONS, dtype=np.int64)
    for i in range(0, len(grams), 1024):  # sums of products start no pool of BLAS threads
        total += (numbers[i : i + 1024, None] * gram_vectors(grams[i : i + 1024], 1 << _BITS)).sum(axis=0)
    return total


def counted(docs):
    """(lang, gram, n) over labelled documents (text, lang)."""

    def count(batches):
        known, total, many = letter_table(), {}, 0

        def merged():
            for lang, parts in total.items():
                gram, number = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                total[lang] = [(gram, number)]
            return sum(len(p[0][0]) for p in total.values())

        def rows():
            for lang, ((gram, number),) in total.items():
                yield pa.record_batch([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(number)], ["lang", "gram", "n"])

        for batch in batches:
            names = pc.fill_null(batch.column(1), "").to_numpy(zero_copy_only=False).astype(str)
            for lo, data, off in blocks(batch.column(0), BLOCK_BYTES):
                langs, of = np.unique(names[lo : lo + len(off) - 1], return_inverse=True)
                doc, gram, number = trigram_counts(data, off, known)
                for k, lang in enumerate(langs.tolist()):
                    some = of[doc] == k
                    total.setdefault(lang, []).append((gram[some], number[some]))
                many += len(gram)
                if many > 4 * COUNTED:
                    many = merged()
                    if many > COUNTED:
                        yield from rows()
                        total, many = {}, 0
        merged()
        yield from rows()

    return docs.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def prototypes(docs):
    """What docs (text, lang) teach; rows with a null in either teach nothing.

    Languages; unit vectors less their mean; the mean; the unit vectors; mean
    and standard deviation of a training trigram's product with its language's.
    """
    spark = docs.sparkSession
    written = Table(counted(docs.filter("text is not null and lang is not null")))

    def bundle(batches):
        total = {}
        for batch in batches:
            names, gram, n = batch.column(0).to_numpy(zero_copy_only=False).astype(str), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lang in np.unique(names).tolist():
                some = names == lang
                total[lang] = total.get(lang, 0) + bundled(gram[some], n[some])
        for lang, x in total.items():
            yield pa.record_batch([pa.array([lang] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(x)], ["lang", "at", "x"])

    sums = {}
    for r in written.df.mapInArrow(bundle, "lang string, at int, x long").groupBy("lang", "at").agg(F.sum("x").alias("x")).collect():
        sums.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["at"]] = r["x"]
    names = sorted(sums)
    profiles = {k: sums[k] / np.linalg.norm(sums[k]) for k in names}
    sent = spark.sparkContext.broadcast(profiles)

    def products(batches):
        for batch in batches:
            langs, gram = batch.column(0).to_numpy(zero_copy_only=False).astype(str), batch.column(1).to_numpy()
            out = np.zeros(len(gram), dtype=np.int64)
            for lang in np.unique(langs).tolist():
                some = np.flatnonzero(langs == lang)
                for i in range(0, len(some), 1024):
                    at = some[i : i + 1024]
                    out[at] = np.round((gram_vectors(gram[at], 1 << _BITS) * sent.value[lang]).sum(axis=1) * FINE)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(out)], ["lang", "n", "p"])

    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("n", "p")}
    moments = written.df.mapInArrow(products, "lang string, n long, p long").groupBy("lang").agg(F.sum(exact["n"]).alias("n"), F.sum(exact["n"] * F.col("p").cast("decimal(10,0)")).alias("x"), F.sum(exact["n"] * (F.col("p") * F.col("p")).cast("decimal(19,0)")).alias("xx"))
    usual = {}
    for r in moments.collect():
        mean = float(r["x"]) / float(r["n"]) / FINE
        usual[r["lang"]] = mean, np.sqrt(max(float(r["xx"]) / float(r["n"]) / FINE**2 - mean**2, 0))
    written.drop()
    matrix = np.array([profiles[k] for k in names]).reshape(len(names), DIMENSIONS)
    shared = matrix.mean(axis=0) if len(names) > 1 else np.zeros(DIMENSIONS)
    own = matrix - shared
    norm = np.linalg.norm(own, axis=1, keepdims=True)
    return names, own / np.where(norm > 0, norm, 1), shared, matrix, np.array([usual[k] for k in names]).reshape(len(names), 2)


def identified(docs, model):
    """docs and their columns with lang_pred, score (the cosine, between 0 and 1) and familiar.

    `und` and 0 if text is null or has no letter, or nothing was learnt.  Only
    the text is looked at.  Ties go to the first language by name.  A text is
    familiar unless its trigrams are too unlike those of lang_pred for their
    number (FAMILIAR, ERRORS); `und` is not, texts of under some 20 different
    trigrams nearly always are.  Existing columns of these three names are replaced; an
    empty table stays empty.
    """
    names, matrix, shared, profiles, usual = model
    docs = docs.drop("lang_pred", "score", "familiar")
    place = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast((matrix.astype(np.float32), shared.astype(np.float32), profiles.astype(np.float32), usual))

    def predict(batches):
        own, mean, whole, usual = sent.value
        # vectors of the trigrams that the task has met
        known, kept, rows, vectors = letter_table(), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((4096, DIMENSIONS), dtype=np.int8)
        for batch in batches:
            for lo, data, off in blocks(batch.column(place), BLOCK_BYTES):
                n = len(off) - 1
                doc, gram, number = trigram_counts(data, off, known)
                different = np.unique(gram)
                unknown = np.setdiff1d(different, kept, assume_unique=True)
                if len(kept) + len(unknown) > VECTORS:
                    kept, rows, unknown = kept[:0], rows[:0], different
                if 0 < len(unknown) <= VECTORS:
                    used = len(kept) + len(unknown)
                    if used > len(vectors):
                        vectors = np.concatenate([vectors, np.zeros((min(VECTORS, max(2 * len(vectors), used)) - len(vectors), DIMENSIONS), dtype=np.int8)])
                    vectors[len(kept) : used] = gram_vectors(unknown, 1 << _BITS)
                    at = np.searchsorted(kept, unknown)
                    rows = np.insert(rows, at, np.arange(len(kept), used))
                    kept = np.insert(kept, at, unknown)
                ends = np.searchsorted(doc, np.arange(n + 1))
                has = ends[1:] > ends[:-1]
                count = number.astype(np.float32)
                fits = len(different) <= VECTORS
                row = rows[np.searchsorted(kept, gram)] if fits else None
                bundle = np.zeros((n, DIMENSIONS), dtype=np.float32)
                for i, (start, stop) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                    for a in range(start, stop, AT_ONCE):
                        b = min(a + AT_ONCE, stop)
                        own_vectors = vectors[row[a:b]] if fits else gram_vectors(gram[a:b], 1 << _BITS)
                        bundle[i] += count[a:b] @ own_vectors.astype(np.float32)
                many = np.maximum(np.bincount(doc, weights=number, minlength=n), 1)
                product = bundle @ whole.T / many[:, None] if names else np.zeros((n, 0))
                norm = np.linalg.norm(bundle, axis=1, keepdims=True)
                bundle = bundle / np.where(norm > 0, norm, 1) - mean
                norm = np.linalg.norm(bundle, axis=1, keepdims=True)
                cosine = (bundle / np.where(norm > 0, norm, 1)) @ own.T if len(names) else np.zeros((n, 0))
                best = cosine.argmax(axis=1) if len(names) else np.zeros(n, dtype=np.int64)
                sure = has & bool(names)
                score = np.where(sure, np.clip(cosine[np.arange(n), best], 0, 1) if len(names) else 0, 0).astype(float)
                familiar = sure.copy()
                if names:
                    mu, sd = usual[best].T
                    familiar &= product[np.arange(n), best] >= np.minimum(FAMILIAR * mu, mu - ERRORS * sd / np.sqrt(np.maximum(np.diff(ends), 1)))
                said = [names[k] if ok else "und" for k, ok in zip(best.tolist(), sure.tolist(), strict=True)]
                part = batch.slice(lo, n)
                yield pa.record_batch([*part.columns, pa.array(said, pa.string()), pa.array(score), pa.array(familiar)], [*part.schema.names, "lang_pred", "score", "familiar"])

    return extended(docs, predict, "lang_pred string, score double, familiar boolean")


def held_out(doc_id):
    """Whether a document is held out from training: crc32 of its id as text, modulo 4, is 2; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
