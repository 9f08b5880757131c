"""Around a token classifier: tokens, word pieces, inputs, labels and spans."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageguard.functions import masking
from pageguard.functions.patterns import SPACE, trim
from pageguard.sources.loaded import memoised

THRESHOLD = 0.85
MOST_TOKENS = 256
#: Pieces that neighbouring chunks share, and chunks that a model gets in one call.
OVERLAP, CHUNKS = 32, 32
#: Code points of texts that a task holds at a time, and so at most as many pieces; a longer text is held alone.
HELD = 100_000
#: Words whose pieces a worker of text_items keeps (about 300 bytes each), and one of encode_pieces.
KNOWN_WORDS, WORDS = 500_000, 20_000

# The classifier's label types (labels 2k - 1 begin and 2k continue type k, 0 is none), and names of types.
MODEL_TYPES = ["AGE", "COORDINATE", "CREDIT_CARD", "DATE_TIME", "EMAIL_ADDRESS", "FINANCIAL", "HONORIFIC", "IBAN_CODE", "IMEI", "IP_ADDRESS", "LOCATION", "MAC_ADDRESS", "NRP", "ORGANIZATION", "PASSWORD", "PERSON", "PHONE_NUMBER", "TITLE", "URL", "US_BANK_NUMBER", "US_DRIVER_LICENSE", "US_ITIN", "US_LICENSE_PLATE", "US_PASSPORT", "US_SSN"]
TYPE_NAMES = {
    "NAME": ["NAME", "PERSON", "GIVENNAME", "FIRSTNAME", "LASTNAME", "SURNAME", "MIDDLENAME"],
    "EMAIL": ["EMAIL"],
    "PHONE": ["TEL", "PHONE", "PHONENUMBER", "PHONEIMEI"],
    "CARD": ["CREDITCARD", "CREDITCARDNUMBER", "CREDITCARDCVV"],
    "IP_ADDRESS": ["IP", "IPV4", "IPV6"],
}
MORE_TYPE_NAMES = {
    "NAME": ["PER"],
    "EMAIL": ["EMAILADDRESS"],
    "LOCATION": ["LOCATION", "LOC", "CITY", "STATE", "COUNTRY"],
    "ORGANIZATION": ["ORGANIZATION", "ORG"],
}
#: One punctuation mark, or a run of characters that are neither that nor white space.
TOKEN = rf"[!-/:-@\[-`{{-~]|[^{SPACE}!-/:-@\[-`{{-~]+"


#: The same for Java, which looks up a class of single Latin-1 characters in a table and tries the ranges of others in turn.
_MARKS = [chr(c) for c in range(33, 127) if re.fullmatch(r"[!-/:-@\[-`{-~]", chr(c))]
_LATIN = [chr(c) for c in range(256) if re.fullmatch(rf"[^{SPACE}!-/:-@\[-`{{-~]", chr(c))]
_CLASS = lambda chars: "[" + "".join(rf"\x{ord(c):02x}" for c in chars) + "]"
JAVA_TOKEN = rf"{_CLASS(_MARKS)}|(?:{_CLASS(_LATIN)}++|[^{SPACE}\x00-\xff])++"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(JAVA_TOKEN), F.lit(0)), F.array().cast("array<string>"))


def token_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, token, begin and end (code points) of every token; linear in a text's tokens, and without a shuffle."""
    names = [id_col, "pos", "token", "begin", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TOKEN).finditer
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [t or "" for t in part.column(1).to_pylist()]
                spans = [[m.span() for m in find(t)] for t in texts]
                row = np.repeat(np.arange(len(texts)), [len(x) for x in spans])
                pos = [i for x in spans for i in range(len(x))]
                words = [t[a:b] for t, x in zip(texts, spans) for a, b in x]
                places = np.array([p for x in spans for p in x], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(pos, pa.int64()), pa.array(words, pa.string()), pa.array(places[:, 0]), pa.array(places[:, 1])], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, pos long, token string, begin long, end long")


def word_pieces(word: str, vocab: dict[str, int], unknown: str = "[UNK]", longest: int = 0) -> list[str]:
    """Longest known beginnings, the later ones with ##; the unknown token if the word cannot be covered.

    longest: letters of the longest piece in vocab, if known; none longer is tried.
    """
    out: list[str] = []
    at = 0
    longest = longest or max(map(len, vocab), default=1)
    while at < len(word):
        for end in range(min(len(word), at + longest), at, -1):
            piece = word[at:end] if at == 0 else "##" + word[at:end]
            if piece in vocab:
                break
        else:
            return [unknown]
        out.append(piece)
        at = end
    return out


def encode_pieces(df: DataFrame, id_col: str, text_col: str, vocab: dict[str, int], lower: bool = True, most: int = MOST_TOKENS) -> DataFrame:
    """id, input_ids with [CLS] and [SEP] (at most `most`), attention_mask, token_type_ids, n_pieces before the cut.

    The cut is the model's; encode_chunks covers what lies beyond it.
    """
    known = df.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, find = _Words(known.value, lower, WORDS), re.compile(TOKEN).finditer
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                rows, sizes = [], []
                for text in part.column(1):
                    ids, n = [], 0
                    for token in find(text.as_py() or ""):
                        own = of[token.group()][0]
                        if n < most - 2:
                            ids += own
                        n += len(own)
                    rows.append(ids[: most - 2])
                    sizes.append(n)
                made = [pa.array(rows, pa.list_(pa.int32())), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=[id_col, "ids", "n_pieces"])

    kind = df.schema[id_col].dataType.simpleString()
    pieces = df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_pieces long")
    inputs = F.concat(F.array(F.lit(vocab["[CLS]"])), "ids", F.array(F.lit(vocab["[SEP]"])))
    out = pieces.select(id_col, inputs.alias("input_ids"), "n_pieces")
    same = lambda x: F.array_repeat(F.lit(x), F.size("input_ids"))
    return out.select(id_col, "input_ids", same(1).alias("attention_mask"), same(0).alias("token_type_ids"), "n_pieces")


class _Words(dict):
    """Word -> ids of its pieces and their ends in the word, kept for as long as a task's worker lives."""

    def __init__(self, vocab: dict[str, int], lower: bool, most: int = 100_000):
        super().__init__()
        self.vocab, self.lower, self.most, self.longest = vocab, lower, most, max(map(len, vocab), default=1)
        self.later = {p[2:]: i for p, i in vocab.items() if p.startswith("##")}
        self.longest_later = max(map(len, self.later), default=1)

    def cut(self, word: str) -> tuple[list[int], list[int]]:
        """Ids of word_pieces's pieces and their ends; first and later pieces are looked up by themselves."""
        low = word.lower() if self.lower else word
        ids, ends, at, n = [], [], 0, len(low)
        known, longest = self.vocab, self.longest
        while at < n:
            end = min(n, at + longest)
            while end > at and (found := known.get(low[at:end])) is None:
                end -= 1
            if end == at:
                return [self.vocab["[UNK]"]], [len(word)]
            ids.append(found)
            ends.append(end)
            at, known, longest = end, self.later, self.longest_later
        return ids, ends if n == len(word) else [len(word)] * len(ids)  # lower case of another length: the word's places

    def __missing__(self, word: str) -> tuple[list[int], list[int]]:
        if len(self) > self.most:
            self.clear()
        self[word] = out = self.cut(word)
        return out


def _pieces(text: str | None, of: _Words, find: Callable) -> tuple[list[int], list[int], list[int]]:
    """Ids of a text's pieces and their places."""
    ids, starts, ends = [], [], []
    for token in find(text or ""):
        own, stops = of[token.group()]
        ids += own
        starts += [token.start() + s for s in [0, *stops[:-1]]]
        ends += [token.start() + s for s in stops]
    return ids, starts, ends


class _Pieces:
    """Pieces of many texts at once: white space and marks are found on arrays, and each word is cut up once."""

    #: Kind of each code point: 0 white space, 1 a mark, which is a token by itself, 2 part of a word.
    KINDS: np.ndarray | None = None

    def __init__(self, vocab: dict[str, int], lower: bool):
        self.words = _Words(vocab, lower, KNOWN_WORDS)
        self._forget()
        if _Pieces.KINDS is None:
            kinds = np.full(0x110000, 2, np.uint8)
            kinds[[c for c in range(0x10000) if re.match(f"[{SPACE}]", chr(c))]] = 0
            kinds[[ord(c) for c in _MARKS]] = 1
            _Pieces.KINDS = kinds

    def _forget(self) -> None:
        """Words by number; of all pieces of the words in that order: ids, and where they begin and end in their word."""
        self.number: dict[str, int] = {}
        self.sizes, self.ids, self.begins, self.ends = array("q"), array("q"), array("q"), array("q")

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self.number) > self.words.most:
            self._forget()
        new_ids, new_begins, new_ends = [], [], []
        for word in set(words).difference(self.number):
            ids, ends = self.words.cut(word)
            self.number[word] = len(self.number)
            self.sizes.append(len(ids))
            new_ids += ids
            new_begins.append(0)
            new_begins += ends[:-1]
            new_ends += ends
        self.ids.extend(new_ids)
        self.begins.extend(new_begins)
        self.ends.extend(new_ends)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: ids of its pieces, and their begins and ends in it."""
        joined = "\n".join(texts)
        kind = _Pieces.KINDS[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        mark, word = kind == 1, kind == 2
        starts = np.flatnonzero(mark | (word & ~np.concatenate(([False], word[:-1]))))
        stops = np.flatnonzero(mark | (word & ~np.concatenate((word[1:], [False])))) + 1
        numbers = self._numbers([joined[a:b] for a, b in zip(starts.tolist(), stops.tolist())])
        sizes = np.frombuffer(self.sizes, np.int64) if self.sizes else np.zeros(0, np.int64)
        own = sizes[numbers]
        until = np.cumsum(own)
        total = int(until[-1]) if len(until) else 0
        piece = np.arange(total) + np.repeat((np.cumsum(sizes) - sizes)[numbers] - (until - own), own)
        at = np.repeat(starts, own)
        flat = [np.frombuffer(x, np.int64)[piece] if total else np.zeros(0, np.int64) for x in (self.ids, self.begins, self.ends)]
        out, offset, done = [], 0, 0
        bounds = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        for text, bound in zip(texts, bounds.tolist()):
            here = slice(done, int(until[bound - 1]) if bound else 0)
            out.append((flat[0][here], flat[1][here] + (at[here] - offset), flat[2][here] + (at[here] - offset)))
            done, offset = here.stop, offset + len(text) + 1
        return out


def encode_chunks(df: DataFrame, id_col: str, text_col: str, vocab: dict[str, int], lower: bool = True, most: int = MOST_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """id, chunk, first (place of the chunk's first piece), input_ids, attention_mask, token_type_ids, starts and ends.

    All pieces of a text lie in chunks of at most `most` inputs that overlap by `overlap` pieces, with the pieces' places
    (0-based code points) in the text; [CLS] and [SEP] have places -1.
    """
    known = df.sparkSession.sparkContext.broadcast(vocab)
    room = most - 2
    names = [id_col, "chunk", "first", "input_ids", "attention_mask", "token_type_ids", "starts", "ends"]
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, find = _Words(known.value, lower), re.compile(TOKEN).finditer
        first_id, last_id = known.value["[CLS]"], known.value["[SEP]"]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, starts, ends = _pieces(text, of, find)
                for n, at in enumerate(range(0, max(len(ids) - overlap, 1), room - overlap)):
                    part = slice(at, at + room)
                    row = [first_id, *ids[part], last_id]
                    for col, x in zip(cols, (key, n, at, row, [1] * len(row), [0] * len(row), [-1, *starts[part], -1], [-1, *ends[part], -1])):
                        col.append(x)
            types = [batch.column(0).type, pa.int32(), pa.int32(), *[ints] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, chunk int, first int, input_ids array<int>, attention_mask array<int>, token_type_ids array<int>, starts array<int>, ends array<int>")


def _best_of(logits: list) -> tuple[np.ndarray, np.ndarray]:
    """Label and confidence of each input of a chunk: the first largest score and its softmax share.

    Scores in float32, as models give them, are not widened before their exponentials.
    """
    x = np.asarray(logits)
    x = x if x.dtype == np.float32 else x.astype(np.float64, copy=False)
    label = x.argmax(axis=1)
    below = x - x[np.arange(len(x)), label][:, None]
    return label, 1.0 / np.exp(below, out=below).sum(axis=1, dtype=np.float64)


def label_chunks(chunks: DataFrame, id_col: str, load: Callable[[], Callable[[list, list, list], list]]) -> DataFrame:
    """encode_chunks's rows with the label and the confidence of each input in place of the inputs, and ner_status.

    The model's logits are reduced to these two in the worker. A chunk on which the model fails has no labels.
    """
    names = [id_col, "chunk", "first", "starts", "ends", "labels", "shares", "ner_status"]

    memo = memoised(load)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs = [batch.column(i).to_pylist() for i in (5, 6, 7)]
            labels, shares, status = [], [], "ok"
            try:
                for label, share in map(_best_of, memo()(*inputs)):
                    labels.append(label.tolist())
                    shares.append(share.tolist())
            except Exception as e:  # the status column carries it
                memo.forget()
                labels, shares, status = [[]] * batch.num_rows, [[]] * batch.num_rows, f"failed: {e}"[:200]
            made = [pa.array(labels, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float64())), pa.array([status] * batch.num_rows, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), *made], names=names)

    kind = chunks.schema[id_col].dataType.simpleString()
    given = chunks.select(*names[:5], "input_ids", "attention_mask", "token_type_ids")
    return given.mapInArrow(run, f"`{id_col}` {kind}, chunk int, first int, starts array<int>, ends array<int>, labels array<int>, shares array<double>, ner_status string")


def piece_labels(labelled: DataFrame, id_col: str) -> DataFrame:
    """id, pos, start, end, prefix, entity_type, confidence of every piece of every text: merge_spans's input.

    A piece that lies in two chunks has the label that it is surer of (a tie goes to the earlier chunk).
    """
    pieces = labelled.select(id_col, "chunk", "first", F.posexplode(F.arrays_zip("starts", "ends", "labels", "shares")).alias("i", "p")).where("p.starts >= 0 and p.labels is not null")
    one = F.struct(F.col("p.starts").alias("start"), F.col("p.ends").alias("end"), F.col("p.labels").alias("label"), F.col("p.shares").alias("confidence"))
    kept = pieces.groupBy(id_col, (F.col("first") + F.col("i") - 1).alias("pos")).agg(F.max_by(one, F.struct("p.shares", -F.col("chunk"))).alias("p")).select(id_col, "pos", "p.*")
    prefix, kind = parse_label(label_name(F.col("label")))
    return kept.select(id_col, "pos", "start", "end", prefix.alias("prefix"), kind.alias("entity_type"), "confidence")


def label_kinds(names: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of labels by number: whether each begins a span, the number of its type (-1: none), and the types' names.

    As parse_label: upper case, B or I before - or _; a label without a prefix begins its type.
    """
    begins, kind, types = [], [], []
    for name in names:
        up = (name or "").strip().upper()
        marked = re.fullmatch("(?s)([BI])[-_](.+)", up)
        of = marked[2] if marked else up
        if up in ("", "O", "0") or of == "O":
            begins.append(False)
            kind.append(-1)
            continue
        if of not in types:
            types.append(of)
        begins.append(not marked or marked[1] == "B")
        kind.append(types.index(of))
    return np.array(begins, bool), np.array(kind, np.int64), types


MODEL_LABELS = ["O", *(f"{p}-{t}" for t in MODEL_TYPES for p in "BI")]


def spans_of(label: np.ndarray, share: np.ndarray, begins: np.ndarray, kind: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """First and last piece, type and mean confidence of one text's spans: what merge_spans does, on arrays."""
    of = kind[label]
    ok = (share >= threshold) & (of >= 0)
    before = np.concatenate(([False], ok[:-1]))
    other = np.concatenate(([True], of[1:] != of[:-1]))
    at = np.flatnonzero(ok)
    first = np.flatnonzero((ok & (begins[label] | ~before | other))[at])
    last = np.concatenate((first[1:], [len(at)])) - 1
    mean = np.add.reduceat(share[at], first) / (last - first + 1) if len(first) else np.zeros(0)
    return at[first], at[last] if len(first) else first, of[at[first]], mean


class _Folded:
    """A text on its way through the model: its pieces, and for each the label that its chunks were surest of so far."""

    def __init__(self, key: object, text: str, pieces: tuple[np.ndarray, np.ndarray, np.ndarray], room: int):
        self.key, self.text, (ids, self.starts, self.ends) = key, text, pieces
        self.ids: list[int] = ids.tolist()
        self.label, self.share = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), -1.0)
        self.chunks = list(range(0, max(len(self.ids) - OVERLAP, 1), room - OVERLAP)) if self.ids else []
        self.status = "ok"

    def add(self, at: int, label: np.ndarray, share: np.ndarray) -> None:
        """A tie goes to the earlier chunk."""
        here = slice(at, at + len(label))
        surer = share > self.share[here]
        self.label[here][surer], self.share[here][surer] = label[surer], share[surer]


def text_items(docs: DataFrame, id_col: str, text_col: str, vocab: dict[str, int], load: Callable[[], Callable[[list, list, list], list]], threshold: float = THRESHOLD, labels: list[str] | None = None, lower: bool = True, on_failure: str = "raise") -> DataFrame:
    """id, type, start, end, match, masked and confidence of what a token classifier finds in whole texts.

    One pass over the texts, without a shuffle: a worker cuts each text into overlapping chunks, gives the model CHUNKS of
    them at a time, takes for each piece the label that a chunk is surer of, and merges runs of labels into spans. load is
    called once a process. labels: the model's names by number (assets.Tokenizer.labels has them).

    A model that fails never reads as `nothing found`. By default the job fails. With on_failure="status" a further column
    ner_status says `ok`, and a text on which the model fails (tried alone once more) has one row, with that status and
    no type; whoever reads it has to treat the whole text as sensitive.
    """
    if on_failure not in ("raise", "status"):
        raise ValueError("on_failure is raise or status")
    known, memo = docs.sparkSession.sparkContext.broadcast(vocab), memoised(load)
    begins, kind, types = label_kinds(labels or MODEL_LABELS)
    room = MOST_TOKENS - 2
    names = [id_col, "type", "start", "end", "match", "confidence", "ner_status"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_texts, named = _Pieces(known.value, lower), pa.array(list(map(wide_type, types)), pa.string())
        first_id, last_id = known.value["[CLS]"], known.value["[SEP]"]

        def label_all(jobs: list[tuple[_Folded, int]]) -> None:
            rows = [[first_id, *t.ids[at : at + room], last_id] for t, at in jobs]
            got = list(map(_best_of, memo()(rows, [[1] * len(r) for r in rows], [[0] * len(r) for r in rows])))
            if [len(label) for label, _ in got] != [len(r) for r in rows]:
                raise ValueError("the model gave logits of another number of inputs")
            for (t, at), (label, share) in zip(jobs, got):
                t.add(at, label[1:-1], share[1:-1])

        def labelled(texts: list[_Folded]) -> None:
            jobs = [(t, at) for t in texts for at in t.chunks]
            for i in range(0, len(jobs), CHUNKS):
                try:
                    label_all(jobs[i : i + CHUNKS])
                except Exception:  # again, text by text: one that the model cannot take is not to fail others
                    memo.forget()
                    for t in dict.fromkeys(t for t, _ in jobs[i : i + CHUNKS]):
                        try:
                            label_all([j for j in jobs[i : i + CHUNKS] if j[0] is t])
                        except Exception as e:
                            memo.forget()
                            if on_failure == "raise":
                                raise
                            t.status = f"failed: {e}"[:200]

        def spans(keys: pa.Array, texts: list[_Folded]) -> pa.RecordBatch:
            labelled(texts)
            key, of, begin, end, share, match, status = [], [], [], [], [], [], []
            for t in texts:
                if t.status != "ok":
                    n, a, b, k, c = 1, [None], [None], [None], [None]
                    match.append(None)
                else:
                    first, last, k, c = (x.tolist() for x in spans_of(t.label, t.share, begins, kind, threshold))
                    n, a, b = len(first), t.starts[first].tolist(), t.ends[last].tolist()
                    match += [t.text[i:j] for i, j in zip(a, b)]
                key += [t.key] * n
                of += k
                begin += a
                end += b
                share += c
                status += [t.status] * n
            made = [named.take(pa.array(of, pa.int32())), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(match, pa.string()), pa.array(share, pa.float64()), pa.array(status, pa.string())]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(key, pa.int64())), *made], names=names)

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = np.cumsum([len(t) for t in texts])
            at = 0
            while at < len(texts):  # as many texts as have HELD code points, and one at least: a piece has one or more
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + HELD, "right")))
                yield spans(batch.column(0), [_Folded(at + i, texts[at + i], p, room) for i, p in enumerate(of_texts(texts[at:to]))])
                at = to

    id_kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_kind}, type string, start int, end int, match string, confidence double, ner_status string")
    status = ["ner_status"] if on_failure == "status" else []
    return found.select(id_col, "type", "start", "end", "match", masking.mask(F.col("type"), F.col("match")).alias("masked"), "confidence", *status)


def classify(inputs: DataFrame, id_col: str, load: Callable[[], Callable[[list, list, list], list]]) -> DataFrame:
    """id, pos and logits from a model given as a loader that runs once a process: (ids, mask, types) -> logits a batch.

    A failing batch yields its ids with ner_status `failed`, never an empty result that would read as `no personal data`.
    """

    memo = memoised(load)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, inputs_, masks, types = (batch.column(i).to_pylist() for i in range(4))
            try:
                logits, status = memo()(inputs_, masks, types), "ok"
            except Exception as e:  # the status column carries it
                memo.forget()
                logits, status = [[] for _ in ids], f"failed: {e}"[:200]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(logits, pa.list_(pa.list_(pa.float32()))), pa.array([status] * len(ids))], names=[id_col, "logits", "ner_status"])

    kind = inputs.schema[id_col].dataType.simpleString()
    return inputs.select(id_col, "input_ids", "attention_mask", "token_type_ids").mapInArrow(run, f"`{id_col}` {kind}, logits array<array<float>>, ner_status string")


def best_label(logits: Column) -> Column:
    """0-based place of the first largest score."""
    return F.array_position(logits, F.array_max(logits)) - 1


def best_share(logits: Column) -> Column:
    """Softmax probability of the best label."""
    top = F.array_max(logits)
    return 1.0 / F.aggregate(F.transform(logits, lambda x: F.exp((x - top).cast("double"))), F.lit(0.0), lambda s, x: s + x)


def label_name(label: Column) -> Column:
    types = F.array(*map(F.lit, MODEL_TYPES))
    kind = F.get(types, F.floor((label - 1) / 2).cast("int"))
    return F.when(label.between(1, 2 * len(MODEL_TYPES)), F.concat(F.when(label % 2 == 1, "B-").otherwise("I-"), kind)).otherwise("O")


def parse_label(label: Column) -> tuple[Column, Column]:
    """Prefix (O, B or I) and type; a label without a prefix begins its type."""
    up = F.upper(trim(label))
    none = F.coalesce((up == "") | (up == "O") | (up == "0"), F.lit(True))
    marked = up.rlike("^[BI][-_].+$")
    prefix = F.when(none, "O").when(marked, F.substring(up, 1, 1)).otherwise("B")
    return prefix, F.when(none, "O").when(marked, F.substring(up, 3, 1 << 20)).otherwise(up)


def wide_type(raw: str) -> str:
    """normalize_type(wide=True) of one name: a model has few, and its items are many."""
    key = re.sub(f"[{SPACE}_-]", "", raw.upper())
    known = {k: [*TYPE_NAMES.get(k, []), *MORE_TYPE_NAMES.get(k, [])] for k in TYPE_NAMES | MORE_TYPE_NAMES}
    known["IP_ADDRESS"].append("IPADDRESS")
    return next((name for name, keys in known.items() if key in keys), key or "UNKNOWN")


def normalize_type(raw: Column, wide: bool = False, compat: bool = False) -> Column:
    """The engine's name of an entity type; unknown ones in upper case.

    wide: the classifier's larger map, where an empty type is UNKNOWN and unknown ones keep the stripped form. compat: it
    also strips a leading B or I that is no BIO prefix, as in PADDRESS for IP_ADDRESS; else IPADDRESS is IP_ADDRESS.
    """
    names = {k: list(v) for k, v in TYPE_NAMES.items()}
    key = F.regexp_replace(F.upper(raw), f"[{SPACE}_-]", "")
    fallback = F.upper(raw)
    if wide:
        for k, v in MORE_TYPE_NAMES.items():
            names.setdefault(k, []).extend(v)
        if compat:
            key = F.regexp_replace(key, "^[BI]", "")
        else:
            names["IP_ADDRESS"] = [*names["IP_ADDRESS"], "IPADDRESS"]
        fallback = F.when(F.coalesce(key, F.lit("")) == "", "UNKNOWN").otherwise(key)
    out = fallback
    for name, keys in names.items():
        out = F.when(key.isin(keys), name).otherwise(out)
    return out


def merge_spans(labels: DataFrame, id_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """id, entity_type, start, end, confidence of merged spans. labels: id, pos, start, end, prefix, entity_type, confidence.

    A token under the threshold or without a type ends the open span; a span also ends where a token begins one or has
    another type. A window holds one text's tokens; text_items does the same for whole texts inside the worker.
    """
    w = Window.partitionBy(id_col).orderBy("pos")
    ok = (F.col("confidence") >= threshold) & (F.col("prefix") != "O") & (F.col("entity_type") != "O")
    rows = labels.withColumn("ok", F.coalesce(ok, F.lit(False)))
    before, kind_before = F.coalesce(F.lag("ok").over(w), F.lit(False)), F.lag("entity_type").over(w)
    starts = F.col("ok") & ((F.col("prefix") == "B") | ~before | (kind_before != F.col("entity_type")))
    rows = rows.withColumn("starts", F.coalesce(starts, F.lit(False)).cast("int")).withColumn("span", F.sum("starts").over(w)).where("ok")
    merged = rows.groupBy(id_col, "span").agg(F.first("entity_type").alias("entity_type"), F.min("start").alias("start"), F.max("end").alias("end"), F.avg("confidence").alias("confidence"))
    return merged.drop("span")
