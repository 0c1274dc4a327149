"""Safe forms of payloads: nested redaction, id caps and compact results."""

from __future__ import annotations

import json
import math
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagia.functions import text as rules

# Workers get the helpers by value, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(rules)

# --- fixed values: names, notices and limits ------------------------------------------------
SENSITIVE_KEYS = frozenset((
    "accesstoken", "apikey", "authorization", "clientsecret", "connectionstring", "cookie",
    "databaseurl", "idtoken", "password", "passwd", "proxyauthorization", "refreshtoken",
    "secret", "setcookie", "token"))
SENSITIVE_ENDINGS = ("apikey", "password", "secret", "token", "cookie")
REDACTED = "[REDACTED]"
VALUE_NOTICE = "[TRUNCATED VALUE LIMIT]"
DEPTH_NOTICE = "[TRUNCATED DEPTH LIMIT]"
OMITTED_KEY = "_trace_truncated"
KEY_LENGTH = 256
KEPT_IDS = 100
DETAIL_FIELDS = {
    "find_samples": ("items",),
    "find_taxa": ("asvs", "sample_occurrences"),
    "taxon_abundance": ("observations",),
    "diversity_analysis": ("observations",),
    "environment_association": ("points",),
}
PAGE_FIELDS = ("page", "asv_page", "sample_page", "point_page")
COMPACT_ITEMS = 20
COMPACT_TEXT = 300
# --- end of fixed values ----------------------------------------------------------------------
#: Characters of JSON that a task holds parsed at a time, whatever the size of its batches.
PIECE_CHARACTERS = 1 << 20
PIECE_TEXTS = 1 << 14
#: Short texts that are parsed as one.
JOINED_TEXTS = 1 << 8


@dataclass(frozen=True)
class Limits:
    depth: int = 8
    items: int = 100
    text: int = 20_000
    values: int = 2_000
    characters: int = 100_000

    def shortest(self) -> int:
        """JSON texts of so many characters reach none of the limits but that of depth: a value takes two of them
        or more, and a secret becomes at most 11 times as long."""
        return min(2 * self.items, 2 * self.values - 1, self.text // 11, self.characters // 11, KEY_LENGTH)


def names_secret(key: str) -> bool:
    """Whether a key, letters and digits only, is that of a secret."""
    letters = re.sub("[^a-z0-9]", "", key.lower())
    return letters in SENSITIVE_KEYS or letters.endswith(SENSITIVE_ENDINGS)


_RULES = [(re.compile(pattern, re.I), re.sub(r"\$(\d)", r"\\\1", to)) for pattern, to in (
    (rules.BEARER, rules.BEARER_TO), (rules.URL_LOGIN, rules.URL_LOGIN_TO), (rules.ASSIGNMENT, rules.ASSIGNMENT_TO))]


def redact_string(value: str) -> str:
    if ":" not in value and "=" not in value and "bearer" not in value.lower():
        return value  # each pattern needs one of them
    for pattern, to in _RULES:
        value = pattern.sub(to, value)
    return value


class Uncounted(str):
    """Text that stands for another value and takes nothing from the budget of characters."""


@dataclass
class Tokens:
    """Payloads as one flat list in reading order: for each value its row, its parent's place and its label.

    A container is an empty dict or list that its values are put into later. ``fixed`` values are
    notices, which no budget counts.
    """

    row: list[int]
    parent: list[int]
    label: list[str | None]
    value: list
    fixed: list[bool]

    def add(self, row: int, parent: int, label: str | None, value, fixed: bool = False) -> int:
        for column, entry in zip((self.row, self.parent, self.label, self.value, self.fixed),
                                 (row, parent, label, value, fixed)):
            column.append(entry)
        return len(self.row) - 1


def flattened(payloads: list, limits: Limits) -> Tokens:
    """All values within the limits of depth and items; what lies beyond them is a notice."""
    tokens = Tokens([], [], [], [], [])
    waiting = [(row, -1, None, payload, 0, False) for row, payload in enumerate(payloads)][::-1]
    while waiting:
        row, parent, label, node, depth, fixed = waiting.pop()
        container = isinstance(node, (dict, list)) and not fixed
        if not container or depth >= limits.depth:
            if isinstance(node, float) and not math.isfinite(node):
                node = Uncounted(node)
            tokens.add(row, parent, label, Uncounted(DEPTH_NOTICE) if container else node, fixed)
            continue
        place = tokens.add(row, parent, label, type(node)())
        entries = list(node.items() if isinstance(node, dict) else ((None, v) for v in node))
        inner = []
        for key, value in entries[:limits.items]:
            name = None if key is None else key[:KEY_LENGTH]
            secret = name is not None and names_secret(name)
            inner.append((row, place, name, REDACTED if secret else value, depth + 1, secret))
        if len(entries) > limits.items:
            omitted = {"omitted_items": len(entries) - limits.items}
            if isinstance(node, dict):
                notice = OMITTED_KEY
                while notice in {i[2] for i in inner}:
                    notice = f"_{notice}"
                inner.append((row, place, notice, omitted, depth + 1, True))
            else:
                inner.append((row, place, None, {OMITTED_KEY: omitted}, depth + 1, True))
        waiting += reversed(inner)
    return tokens


def within_rows(rows: np.ndarray, amounts: np.ndarray) -> np.ndarray:
    """Running sums, each row's from its own first entry."""
    total = np.cumsum(amounts)
    first = np.searchsorted(rows, rows)
    return total - (total[first] - amounts[first])


def sanitize_batch(payloads: list, limits: Limits = Limits()) -> list[dict]:
    """Payloads with secrets and excess replaced; one that is no object is wrapped.

    The budgets of values and characters are running sums over the flat list.
    """
    tokens = flattened(payloads, limits)
    rows, fixed = np.array(tokens.row), np.array(tokens.fixed, dtype=bool)
    over = ~fixed & (within_rows(rows, (~fixed).astype(int)) > limits.values)
    gone = np.zeros(len(rows), dtype=bool)
    for i in np.flatnonzero(over | fixed):  # what stands inside a replaced container
        up = tokens.parent[i]
        gone[i] = up >= 0 and (over[up] or gone[up])
    texts = [redact_string(v) if type(v) is str and not f else "" for v, f in zip(tokens.value, fixed | over)]
    whole = np.array([len(t) for t in texts])
    most = np.minimum(whole, limits.text)
    spent = within_rows(rows, most) - most
    room = np.clip(limits.characters - spent, 0, most)
    roots: dict[int, object] = {}
    for i, value in enumerate(tokens.value):
        if gone[i]:
            continue
        if over[i]:
            value = VALUE_NOTICE
        elif type(value) is str and not fixed[i]:
            rest = whole[i] - room[i]
            value = f"{texts[i][:room[i]]}\n[TRUNCATED {rest} CHARACTERS]" if rest else texts[i]
        up, label = tokens.parent[i], tokens.label[i]
        if up < 0:
            roots[tokens.row[i]] = value
        elif label is None:
            tokens.value[up].append(value)
        else:
            tokens.value[up][label] = value
    return [roots[r] if isinstance(roots[r], dict) else {"value": roots[r]} for r in range(len(payloads))]


def sanitize_mapping(payload, limits: Limits = Limits()) -> dict | None:
    """One payload in its safe form."""
    return None if payload is None else sanitize_batch([payload], limits)[0]


def _parsed(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


_encode = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


#: Keys seen, which are few beside values, and whether they name secrets.
_SEEN_KEYS: dict[str, bool] = {}


def _seen_secret(key: str) -> bool:
    known = _SEEN_KEYS.get(key)
    if known is None:
        if len(_SEEN_KEYS) >= PIECE_TEXTS:
            _SEEN_KEYS.clear()
        known = _SEEN_KEYS[key] = names_secret(key)
    return known


def _redacted(node):
    """A value that reaches no limit, without its secrets; containers are changed in place."""
    kind = type(node)
    if kind is str:
        return redact_string(node)
    if kind is dict:
        for key, value in node.items():
            node[key] = REDACTED if _seen_secret(key) else value if type(value) is int else _redacted(value)
    elif kind is list:
        node[:] = map(_redacted, node)
    elif kind is float and not math.isfinite(node):
        return str(node)
    return node


def safe_forms(texts: Iterable[str | None], limits: Limits = Limits()) -> Iterator[dict | None]:
    """The safe form of each JSON text in turn, None for null and JSON's null.

    Short texts, which reach no limit, need no budgets. The others are flattened some at a time.
    """
    short, held, long, size = limits.shortest(), [], [], 0

    def ready():
        for place, safe in zip(long, sanitize_batch([held[i] for i in long], limits) if long else ()):
            held[place] = safe
        return held

    for text in texts:
        payload = None if text is None else _parsed(text)
        if payload is None:
            held.append(None)
        elif len(text) <= short and text.count("{") + text.count("[") <= limits.depth:
            safe = _redacted(payload)
            held.append(safe if type(safe) is dict else {"value": safe})
        else:
            long.append(len(held))
            held.append(payload)
        size += len(text or "")
        if size >= PIECE_CHARACTERS or len(held) >= PIECE_TEXTS:
            yield from ready()
            held, long, size = [], [], 0
    yield from ready()


def _together(texts: list[str | None], limits: Limits) -> list[str] | None:
    """The safe forms of short objects without objects in them, parsed and written as one list; None for other texts.

    With as many braces as texts, one at each end of a text, a list of as many objects has used each of them, so it
    holds what each text alone would be parsed to.
    """
    if None in texts or max(map(len, texts)) > limits.shortest():
        return None
    joined, many = ",".join(texts), len(texts)
    if joined.count("[") >= limits.depth or not joined.count("{") == joined.count("}") == many:
        return None
    if joined[0] != "{" or joined[-1] != "}" or [len(t) + 2 for t in joined[1:-1].split("},{")] != [*map(len, texts)]:
        return None
    found = _parsed(f"[{joined}]")
    if type(found) is not list or len(found) != many or {*map(type, found)} != {dict}:
        return None
    safe = _encode([*map(_redacted, found)])
    if not safe.count("{") == safe.count("}") == many:
        return None  # a brace came out of an escape
    return [f"{{{t}}}" for t in safe[2:-2].split("},{")]


def safe_texts(texts: Iterable[str | None], limits: Limits = Limits()) -> Iterator[str]:
    """``safe_forms`` as JSON texts."""
    texts = iter(texts)
    while piece := list(islice(texts, JOINED_TEXTS)):
        yield from _together(piece, limits) or map(_encode, safe_forms(piece, limits))


# A flat object as it is written here: in its keys and texts no sign that divides its parts, asks for an escape or stands
# in a credential. Of such objects every brace, colon and comma is a part's end.
_KEY, _TEXT = r'"[ !#-+\--9;-Z^-z|~]*"', r'"[ !#-+\--9;<>-Z^-z|~]*"'
_PAIR = rf"{_KEY}:(?:{_TEXT}|-?[1-9][0-9]{{0,17}}|0|true|false|null)"
FLAT = rf"^\{{{_PAIR}(?:,{_PAIR})*\}}$"
_REPLACED = np.frombuffer(_encode(REDACTED).encode(), np.uint8)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text ends, and the bytes of all."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]
    return ends[1:] - ends[0], data


def _flat(texts: pa.Array, limits: Limits) -> pa.Array:
    """Whether each text is a short flat object that changes in the values of secret keys only, repeated keys aside."""
    short = pc.less_equal(pc.binary_length(texts), limits.shortest() if limits.depth > 0 else -1)
    flat = pc.fill_null(pc.and_(short, pc.match_substring_regex(texts, FLAT)), False)
    if b"bearer" in _bytes(texts)[1].tobytes().lower():
        flat = pc.and_(flat, pc.invert(pc.fill_null(pc.match_substring(texts, "bearer", ignore_case=True), False)))
    return flat


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which bytes lie in the spans, which are in order and apart."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool)


def _strings(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _flat_safe(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The safe forms of flat objects, all at once over their bytes, and which of them have a key twice."""
    ends, data = _bytes(texts)
    comma = data == ord(",")
    heads, colons = np.flatnonzero(comma | (data == ord("{"))) + 1, np.flatnonzero(data == ord(":"))
    tails = np.flatnonzero(comma | (data == ord("}")))
    keys = _strings(np.cumsum(colons - heads), data[_spans(data, heads, colons)]).dictionary_encode()
    code, names = keys.indices.to_numpy(), keys.dictionary.to_pylist()
    owner = np.searchsorted(ends, heads, side="right")
    place = np.sort(owner * len(names) + code)
    twice = np.zeros(len(texts), bool)
    twice[place[1:][place[1:] == place[:-1]] // len(names)] = True
    secret = np.array([_seen_secret(name[1:-1]) for name in names])[code]
    if not secret.any():
        return texts, twice
    start, stop, size = colons[secret] + 1, tails[secret], len(_REPLACED)
    grown = np.cumsum(size - (stop - start))
    out = np.empty(len(data) + int(grown[-1]), np.uint8)
    at = start + np.concatenate([[0], grown[:-1]])
    new = _spans(out, at, at + size)
    out[~new] = data[~_spans(data, start, stop)]
    out[new] = np.tile(_REPLACED, len(at))
    return _strings(ends + np.concatenate([[0], grown])[np.searchsorted(owner[secret], np.arange(len(texts)), side="right")], out), twice


def safe_column(column: pa.Array, limits: Limits = Limits()) -> pa.Array:
    """``safe_texts`` of a column. Short flat objects are worked on together as bytes, all other texts one by one."""
    done = []
    for at in range(0, len(column), PIECE_TEXTS):
        texts = column.slice(at, PIECE_TEXTS).cast(pa.string())
        flat = _flat(texts, limits).to_numpy(zero_copy_only=False)
        if flat.any():
            safe, twice = _flat_safe(texts.filter(pa.array(flat)))
            if twice.any():
                safe = safe.filter(pa.array(~twice))
                flat[np.flatnonzero(flat)[twice]] = False
            texts = pc.replace_with_mask(texts, pa.array(flat), safe)
        if not flat.all():
            rest = pa.array(~flat)
            texts = pc.replace_with_mask(texts, rest, _in_pieces(safe_texts(_texts(texts.filter(rest)), limits)))
        done.append(texts)
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def _texts(column: pa.Array) -> Iterator[str | None]:
    """A column's texts, of which few are Python's at a time."""
    for at in range(0, len(column), PIECE_TEXTS):
        yield from column.slice(at, PIECE_TEXTS).to_pylist()


def _in_pieces(texts: Iterable[str | None]) -> pa.Array:
    """The texts as a column, which is built a piece at a time."""
    texts, done = iter(texts), []
    while piece := list(islice(texts, PIECE_TEXTS)):
        done.append(pa.array(piece, pa.string()))
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def sanitizer(limits: Limits = Limits()):
    """A column function over JSON texts."""
    @F.arrow_udf(T.StringType())
    def sanitize_json(payloads: pa.Array) -> pa.Array:
        given = payloads.is_valid()  # JSON's null stays null
        safe = safe_column(payloads, limits)
        return pc.if_else(given, safe, pa.scalar(None, pa.string()))
    return sanitize_json


def sanitize_payloads(frame: DataFrame, columns: list[str], limits: Limits = Limits()) -> DataFrame:
    """Replace JSON text columns by their safe form; works on tables and streams alike."""
    safe = sanitizer(limits)
    return frame.withColumns({c: safe(F.col(c)) for c in columns})


def cap_ids(ids: Column, kept: int = KEPT_IDS) -> tuple[Column, Column]:
    """The first ids, and how many were left out (null when none)."""
    over = F.size(ids) - kept
    return F.slice(ids, 1, kept), F.when(over > 0, over)


# -- updates of a span -------------------------------------------------------------------------

UPDATE_PAYLOADS = ("input_data", "output_data", "error_data", "model_parameters", "filters")
UPDATE_LISTS = ("data_sources", "artifact_refs")
OMITTED_IDS = "sample_ids_omitted"


def list_sanitizer(limits: Limits = Limits()):
    """A column function over arrays of JSON texts; what is null or JSON's null becomes an empty object."""
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def sanitize_list(lists: pa.Array) -> pa.Array:
        safe = safe_column(lists.flatten(), limits)
        safe = pc.if_else(pc.equal(safe, "null"), "{}", safe)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        return pa.ListArray.from_arrays(offsets, safe, mask=lists.is_null())
    return sanitize_list


def attribute_sanitizer(limits: Limits = Limits()):
    """A column function over attributes as JSON text and the number of ids left out, which is added to them."""
    @F.arrow_udf(T.StringType())
    def sanitize_attributes(payloads: pa.Array, omitted: pa.Array) -> pa.Array:
        def told():
            for safe, more in zip(safe_forms(_texts(payloads), limits), _texts(omitted)):
                if more is not None:
                    safe = {**(safe or {}), OMITTED_IDS: more}
                yield None if safe is None else _encode(safe)
        return _in_pieces(told())
    return sanitize_attributes


def sanitize_updates(updates: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Updates of spans as they may be stored; of the columns below, those that there are.

    Payloads are JSON texts in their safe form. ``error_message`` loses credentials and what is too long, ``sample_ids``
    all but the first ids, whose number goes into ``attributes``, also where there were none. Of the
    lists of JSON texts ``data_sources`` and ``artifact_refs`` the first entries stay, in their safe form.
    """
    there = set(updates.columns)
    safe, safe_list, safe_attributes = sanitizer(limits), list_sanitizer(limits), attribute_sanitizer(limits)
    changes = {c: safe(F.col(c)) for c in UPDATE_PAYLOADS if c in there}
    changes |= {c: safe_list(F.slice(c, 1, limits.items)) for c in UPDATE_LISTS if c in there}
    if "error_message" in there:
        changes["error_message"] = rules.safe_text(F.col("error_message"))
    kept, omitted = cap_ids(F.col("sample_ids"), limits.items) if "sample_ids" in there else (None, F.lit(None).cast("int"))
    if kept is not None:
        changes["sample_ids"] = kept
    if "attributes" in there:
        changes["attributes"] = safe_attributes(F.col("attributes"), omitted)
    elif kept is not None:
        changes["attributes"] = safe_attributes(F.lit(None).cast("string"), omitted)
    return updates.withColumns(changes)


# -- compact results -------------------------------------------------------------------------

def compact(column: Column, kind: T.DataType) -> Column:
    """Lists of at most 20 items and texts of at most 300 characters, at every depth.

    The expression follows the column's type, so it stays inside the JVM.
    """
    if isinstance(kind, T.StringType):
        return F.when(F.char_length(column) > COMPACT_TEXT,
                      F.concat(F.substring(column, 1, COMPACT_TEXT), F.lit("..."))).otherwise(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(F.slice(column, 1, COMPACT_ITEMS), lambda v: compact(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: compact(v, kind.valueType))
    if isinstance(kind, T.StructType):
        built = F.struct(*[compact(column[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(column.isNotNull(), built)
    return column


def compact_result(results: DataFrame, tool: str) -> DataFrame:
    """What an answer needs of a typed result: no detail lists, page totals only."""
    kept = []
    for field in results.schema.fields:
        if field.name in DETAIL_FIELDS.get(tool, ()):
            continue
        column = F.col(field.name)
        if field.name in PAGE_FIELDS and isinstance(field.dataType, T.StructType):
            kept.append(F.struct(column["total"].alias("total")).alias(field.name))
        else:
            kept.append(compact(column, field.dataType).alias(field.name))
    return results.select(*kept)
