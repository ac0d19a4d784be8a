"""Column functions on text, which run inside the JVM, and tokens of Arrow arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token pattern that keeps identifiers such as tlm-330 whole; list-item lead.
TOKEN_PATTERN = r"[a-z0-9]+(?:[-_.][a-z0-9]+)*"
LIST_LEAD = r"^\s*[-*\d.)]+\s*"


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1; null for null."""
    return F.when(text.isNotNull(), F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int")))


def tokens(text: Column) -> Column:
    """Lower-case tokens in order; identifiers with inner - _ . stay whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


#: Bytes of text of which the tokens are held at a time.
TEXT_BYTES = 4 << 20


def stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive rows with at most TEXT_BYTES of text, or one row."""
    ends, low = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(), dtype=np.int64), 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TEXT_BYTES, "right")))
        yield low, high
        low = high


#: What each byte of a lower-case text is: 1 a letter or digit of TOKEN_PATTERN, 2 what may join two.
_BYTES = np.zeros(256, np.uint8)
_BYTES[list(b"abcdefghijklmnopqrstuvwxyz0123456789")], _BYTES[list(b"-_.")] = 1, 2


def found_tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each token, the tokens in order) of lower-case texts: what TOKEN_PATTERN finds, by classes of bytes."""
    if not len(texts):
        return np.empty(0, np.int64), pa.array([], pa.string())
    ended = pa.compute.binary_join_element_wise(pa.compute.fill_null(texts.cast(pa.string()), ""), " ", "")  # no token runs into the next text
    offsets = np.frombuffer(ended.buffers()[1], np.int32)[ended.offset : ended.offset + len(ended) + 1]
    data = np.frombuffer(ended.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    kind = _BYTES[data]
    inside, joins = kind == 1, kind == 2
    joins[0] = False
    joins[1:] &= inside[:-1]
    joins[:-1] &= inside[1:]
    inside |= joins
    edges = np.flatnonzero(np.diff(inside, prepend=False))  # the last byte is a space
    starts, sizes = edges[::2], np.diff(edges)[::2]
    at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return np.searchsorted(offsets - offsets[0], starts, "right") - 1, pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(data[inside]))


def breadcrumb(file: Column, headings: Column) -> Column:
    """file and the non-empty headings joined by ' > '."""
    return F.array_join(F.concat(F.array(file), F.filter(headings, lambda h: h != "")), " > ")


def normalise_entity(name: Column) -> Column:
    """Canonical node key: possessives, quotes, underscores and spacing folded, identifiers joined."""
    n = F.regexp_replace(F.lower(F.trim(name)), r"'s(?=\s|$)", "")
    n = F.regexp_replace(n, "[`\"']", "")
    n = F.regexp_replace(F.replace(n, F.lit("_"), F.lit(" ")), r"\s+", " ")
    n = F.regexp_replace(n, r"\b([a-z]{2,4}) (\d{3})\b", "$1-$2")
    return F.regexp_replace(n, r"\bsev (\d)\b", "sev$1")


def normalise_relation(name: Column) -> Column:
    """Trimmed lower case with white space as underscores."""
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", "_")


def normalise_transcript(text: Column) -> Column:
    """Lower case without punctuation other than - and _, spacing collapsed; letters of any script stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\w\s-]", ""), r"(?U)\s+", " "))


def clean_list(output: Column, longer_than: int) -> Column:
    """Lines of a model's list without bullets or numbers, those over longer_than characters."""
    lines = F.transform(F.split(output, "\n"), lambda x: F.trim(F.regexp_replace(x, LIST_LEAD, "")))
    return F.filter(lines, lambda x: F.length(x) > longer_than)


def with_context(context: Column, chunk: Column) -> Column:
    """context, a blank line, chunk."""
    return F.concat(context, F.lit("\n\n"), chunk)


def situating_prompt(document: Column, chunk: Column, most: int = 8000) -> Column:
    """What a model is asked for a chunk's context: the document up to `most` characters (a model's
    window, the chunk itself is whole) and the chunk."""
    ask = "Say in one short sentence what this document is about and which part of it the chunk covers. Give only the sentence."
    return F.concat(F.lit("<document>\n"), F.substring(document, 1, most), F.lit("\n</document>\n\n<chunk>\n"), chunk, F.lit(f"\n</chunk>\n\n{ask}"))


def contextual_chunks(df: DataFrame, document: str, chunk: str, generate: Callable[[DataFrame], DataFrame], most: int = 8000) -> DataFrame:
    """df with contextual: the chunk below the context a model writes for it. generate takes df with a
    prompt column and adds context; where that is null or blank the chunk stands alone."""
    made = generate(df.withColumn("prompt", situating_prompt(F.col(document), F.col(chunk), most)))
    said = F.trim("context")
    return made.withColumn("contextual", F.when(F.coalesce(said, F.lit("")) != "", with_context(said, F.col(chunk))).otherwise(F.col(chunk))).drop("prompt", "context")


def outline(text: Column, stem: Column) -> Column:
    """struct(title, sections, n_bytes): first '# ' line (else stem), the '## ' lines, UTF-8 size."""
    lines = F.split(text, "\n")
    title = F.get(F.filter(lines, lambda x: x.startswith("# ")), F.lit(0))
    sections = F.transform(F.filter(lines, lambda x: x.startswith("## ")), lambda x: F.trim(F.substring(x, 4, 1 << 30)))
    return F.struct(F.coalesce(F.trim(F.substring(title, 3, 1 << 30)), stem).alias("title"), sections.alias("sections"), F.octet_length(text).alias("n_bytes"))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """template with each {name} replaced by its value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def contains_all(text: Column, needles: Column) -> Column:
    """Whether every needle occurs in text, ignoring case; true for no needles."""
    return F.forall(needles, lambda n: F.contains(F.lower(text), F.lower(n)))


def hints(text: Column, table: dict[str, str]) -> Column:
    """'key = "value"' of every key that occurs in text, joined by ', ' in the table's order."""
    said = F.array(*[F.when(F.contains(text, F.lit(k)), F.lit(f'{k} = "{v}"')) for k, v in table.items()])
    return F.array_join(F.array_compact(said), ", ")


def citations(text: Column) -> Column:
    """Distinct numbers of [n] marks, ascending; digit runs beyond a bigint are left out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("bigint"))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def json_object_span(text: Column) -> Column:
    """The span from the first { to the last }, code fences stripped; null if there is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.when(fenced != "", fenced).otherwise(text)
    span = F.regexp_extract(inner, r"(?s)\{.*\}", 0)
    return F.when(span != "", span)


def parsed_object(text: Column) -> Column:
    """variant of the object in a model's output without repair, null if it isn't a JSON object."""
    value = F.try_parse_json(json_object_span(text))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)
