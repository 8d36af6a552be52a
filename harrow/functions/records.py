"""Records in JSON payloads: finding lists of them, flattening, totals and paging. The walks over a parsed payload are small helpers;
what they yield is rows at once, and everything after is DataFrame work."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import parse_qs, parse_qsl, urlencode, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that feeds use.
PAGE_KEYS = ["page", "pageNumber", "pageNo", "page_num", "pageIndex", "p"]
OFFSET_KEYS = ["offset", "start", "from", "skip"]
LIMIT_KEYS = ["limit", "pageSize", "per_page", "perPage", "size", "rows", "hitsPerPage", "first", "count"]
TOTAL_KEYS = ["total", "totalCount", "total_count", "totalResults", "totalRows", "numFound", "recordsTotal", "totalElements", "totalItems"]
TOLD = {*TOTAL_KEYS, "count", "nbHits", "nbPages", "hitsPerPage"}  # under which total_of looks
SEARCH_PAGE_SIZE = 1000
DEEPEST, SHOWN = 4, 3


def parsed(payload: str | None):
    try:
        return json.loads(payload) if payload else None
    except ValueError:
        return None


def outlined(payload: str | None):
    """A payload as parsed, of whose objects only what record_sets and total_of look at is kept: keys, objects and lists, and what may say a total. Objects with nothing but the same keys are one, however many there are."""
    once: dict = {}

    def outline(pairs: list):
        kept = {k: v if k in TOLD or isinstance(v, (dict, list)) else None for k, v in pairs}
        return kept if any(v is not None for v in kept.values()) else once.setdefault(tuple(kept), kept)

    try:
        return json.loads(payload, object_pairs_hook=outline) if payload else None
    except ValueError:
        return None


def tolerant(answer: str | None):
    """JSON in an answer with fences or words around it: what lies between the outermost braces."""
    body = (answer or "").replace("```json", "").replace("```", "").strip()
    whole = parsed(body)
    return whole if whole is not None else parsed(body[body.find("{") : body.rfind("}") + 1])


def js(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def said(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    return value if isinstance(value, str) else str(value)


def record_sets(node, path: str = ""):
    """(path, records) of each list that is mostly objects which share two keys, outer lists first; of a list only the first entry is searched."""
    below = lambda k: f"{path}.{k}" if path else str(k)
    if isinstance(node, dict):
        for k, v in node.items():
            yield from record_sets(v, below(k))
    elif isinstance(node, list) and node:
        objects = [x for x in node if isinstance(x, dict)]
        if len(objects) >= 2 and 2 * len(objects) >= len(node) and len(set.intersection(*map(set, objects[:10]))) >= 2:
            yield path, objects
        yield from record_sets(node[0], below(0)) if isinstance(node[0], (dict, list)) else ()


def flattened(node, path: str = "", depth: int = 0):
    """(key, value as text or null, whether boolean) of each cell of a record."""
    if depth > DEEPEST:
        yield path or "value", js(node), False
    elif isinstance(node, dict):
        for k, v in node.items():
            yield from flattened(v, f"{path}.{k}" if path else k, depth + 1)
    elif isinstance(node, list):
        if not node:
            yield path, "", False
        elif any(isinstance(x, (dict, list)) for x in node):
            for i, x in enumerate(node[:SHOWN]):
                yield from flattened(x, f"{path}.{i}", depth + 1)
        else:
            yield path, ", ".join(map(said, node)), False
    else:
        yield path or "value", None if node is None else said(node), isinstance(node, bool)


def whole(v) -> bool:
    return not isinstance(v, bool) and (isinstance(v, int) and v >= 0 or isinstance(v, float) and v.is_integer() and v >= 0)


def number_under(node, keys: list[str], skip: tuple[str, ...] = ("hits",), lists: bool = True):
    """The first whole number under one of the keys, an object's own before those below it."""
    if isinstance(node, dict):
        own = next((int(node[k]) for k in keys if whole(node.get(k))), None)
        below = (v for k, v in node.items() if k not in skip)
    elif isinstance(node, list) and lists:
        own, below = None, iter(node)
    else:
        return None
    return own if own is not None else next((x for v in below if (x := number_under(v, keys, skip, lists)) is not None), None)


def total_of(payload, written: str | None = None):
    """The number of rows a payload states: hits, then totals (count last), then pages times page size. written: its text, if at hand; hits that it doesn't name aren't looked for in all of its records."""
    named = written is None or "nbHits" in written or "\\u" in written  # letters may be escaped
    found = number_under(payload, ["nbHits"]) if named else None
    if found is None and isinstance(payload, dict):
        found = number_under(payload, TOTAL_KEYS, (), lists=False)
        if found is None:
            found = number_under(payload, ["count"], (), lists=False)
        if found is None and (pages := number_under(payload, ["nbPages"])) is not None and (per := number_under(payload, ["hitsPerPage"])):
            found = pages * per
    return found


def at_path(node, path: str):
    for part in path.split(".") if path else ():
        if isinstance(node, list):
            node = node[int(part)] if part.isdigit() and int(part) < len(node) else None
        else:
            node = node.get(part) if isinstance(node, dict) else None
    return node


def limit_in(source: dict) -> dict:
    def number(v):
        return v if whole(v) else int(v) if isinstance(v, str) and v.isdigit() else None

    return next(({"limit_key": k, "page_size": int(number(source[k]))} for k in LIMIT_KEYS if k in source and number(source[k]) is not None), {})


def paging_of(url: str, body) -> dict | None:
    """How a request asks for its page: style, key, path, first, and its limit key and page size if it has them."""

    def own(source: dict, test: Callable, style: str, path: str = ""):
        for keys, kind in ((PAGE_KEYS, "page"), (OFFSET_KEYS, "offset")):
            for k in keys:
                if test(source.get(k)):
                    return {"style": f"{style}_{kind}", "key": k, "path": f"{path}.{k}" if path else k, "first": int(source[k])} | limit_in(source)
        return None

    def nested(source: dict, path: str = ""):
        for k, v in source.items():
            if isinstance(v, dict) and k != "requests":
                below = f"{path}.{k}" if path else k
                if found := own(v, whole, "body_nested", below) or nested(v, below):
                    return found
        return None

    def encoded(source: dict):
        places = [("params", source.get("params"))]
        places += [(f"requests.{i}.params", r.get("params")) for i, r in enumerate(source.get("requests") or ()) if isinstance(r, dict)] if isinstance(source.get("requests"), list) else []
        for path, raw in places:
            asked = {k.lower() for k, _ in parse_qsl(raw, keep_blank_values=True)} if isinstance(raw, str) else set()
            if asked & {"query", "filters", "facetfilters", "optionalfilters", "hitsperpage", "page"}:
                page = parse_qs(raw).get("page", ["0"])[0]
                return {"style": "body_params_page", "key": "page", "path": path, "first": int(page) if page.isdigit() else 0, "limit_key": "hitsPerPage", "page_size": SEARCH_PAGE_SIZE}
        return None

    if isinstance(body, dict) and (found := own(body, whole, "body") or encoded(body) or nested(body)):
        return found
    query = dict(parse_qsl(urlsplit(url or "").query, keep_blank_values=True)) if "://" in (url or "") else {}
    return own(query, lambda v: isinstance(v, str) and v.isdigit() and v.isascii(), "query")


def body_without_page(body, paging: dict | None):
    """A request's body without its page, to tell datasets apart."""
    if not paging or not isinstance(body, dict) or paging["style"].startswith("query"):
        return body
    copy = json.loads(json.dumps(body))
    *parents, last = paging["path"].split(".")
    holder = at_path(copy, ".".join(parents))
    if paging["style"] == "body_params_page":
        holder[last] = urlencode([kv for kv in parse_qsl(holder[last], keep_blank_values=True) if kv[0] != "page"])
    else:
        holder.pop(last, None)
    return copy


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _batched(df: DataFrame, run: Callable, schema: str, each: int = 500, size: int = 4 << 20) -> DataFrame:
    """What run yields for each row. Some hundred rows are held at a time, fewer if they are long (size: bytes), as plain values: records in pandas frames cost more than the walks over payloads."""

    def batches(it):
        for whole in it:
            some = max(1, min(each, whole.num_rows * size // max(1, whole.nbytes)))
            for at in range(0, whole.num_rows, some):
                part = whole.slice(at, some)
                rows = [r for values in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in run(dict(zip(part.schema.names, values, strict=True)))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names, kinds = zip(*(c.split() for c in schema.split(",")), strict=True)
    types = [_TYPES[k] for k in kinds]
    return df.mapInArrow(batches, schema)


def find_record_sets(captures: DataFrame, id: str = "id", payload: str = "payload") -> DataFrame:
    """(id, set_ord, path, size, total): each list of records of each payload."""

    def run(r):
        body = outlined(r[payload])
        total = total_of(body, r[payload])
        for i, (path, records) in enumerate(record_sets(body)):
            yield r[id], i, path, len(records), total

    return _batched(captures.select(id, payload), run, f"{id} long, set_ord int, path string, size int, total long").withColumn("total", F.col("total"))


def record_cells(captures: DataFrame, id: str = "id", payload: str = "payload") -> DataFrame:
    """(id, path, row, key, key_pos, value, boolean): the cells of the records of the largest list of each payload, the first of equals."""

    def run(r):
        found = list(record_sets(parsed(r[payload])))
        if not found:
            return
        path, records = max(found, key=lambda x: len(x[1]))
        for i, record in enumerate(records):
            cells = {}
            for k, v, b in flattened(record):
                cells[k] = (v, b)
            for p, (k, (v, b)) in enumerate(cells.items()):
                yield r[id], path, i, k, p, v, b

    return _batched(captures.select(id, payload), run, f"{id} long, path string, row int, key string, key_pos int, value string, boolean boolean")


PAGING = "style string, key string, path string, first long, limit_key string, page_size long"


def detect_paging(url: Column, body: Column) -> Column:
    @F.pandas_udf(PAGING)
    def run(u: pd.Series, b: pd.Series) -> pd.DataFrame:
        names = [c.split()[0] for c in PAGING.split(", ")]
        return pd.DataFrame([{n: None for n in names} | (paging_of(x, parsed(y)) or {}) for x, y in zip(u, b, strict=True)], columns=names).astype({"first": "Int64", "page_size": "Int64"})

    return run(url, body)


def dataset_key(method: Column, url: Column, body: Column, json_path: Column) -> Column:
    """What captured pages of one dataset share: method, address without query, body without its page, and the path of the records."""

    @F.pandas_udf("string")
    def bare(u: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([js(body_without_page(p, paging_of(x, p))) if (p := parsed(y)) is not None else "" for x, y in zip(u, b, strict=True)])

    return F.sha2(F.concat_ws("\u0001", method, F.split(url, r"\?")[0], bare(url, body), json_path), 256)


def page_requests(feeds: DataFrame, pages: int) -> DataFrame:
    """feeds (url, paging) with page_index and page_url for so many pages: page first + i, or offset first + i * size, in the query."""
    p = F.col("paging")
    step = F.when(p["style"].endswith("offset"), F.coalesce(p["page_size"], F.lit(1))).otherwise(1)
    number = p["first"] + F.col("page_index") * step
    out = feeds.withColumn("page_index", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
    url = F.when(p["style"].startswith("query"), F.regexp_replace(F.col("url"), F.concat(F.lit(r"([?&]"), p["key"], F.lit("=)[0-9]+")), F.concat(F.lit("$1"), number.cast("string")))).otherwise(F.col("url"))
    return out.withColumns({"page_number": number, "page_url": url})


def dig(payload: Column, path: str) -> Column:
    """What lies at a dotted path of a JSON payload, as text or JSON; null if nothing does."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        found = s.map(lambda x: at_path(parsed(x), path))
        return found.map(lambda v: None if v is None else js(v) if isinstance(v, (dict, list)) else said(v))

    return run(payload)


def number_in(payload: Column, keys: list[str]) -> Column:
    """The first whole number under one of the keys of a JSON payload; ["paginationLimitedTo"] gives a feed's cap."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: number_under(parsed(x), keys)).astype("Int64")

    return run(payload)


def stated_total(payload: Column) -> Column:
    """The number of rows that a JSON payload states, as total_of."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: total_of(parsed(x))).astype("Int64")

    return run(payload)


def tolerant_json(answer: Column) -> Column:
    """The JSON in an answer with fences or words around it, as tolerant; null if there is none. As an expression: fences go, and what lies between the outermost braces is read where the whole can't be."""
    body = F.trim(F.regexp_replace(F.coalesce(answer, F.lit("")), "```(json)?", ""))
    inner = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    valid = lambda c: F.when(F.get_json_object(c, "$").isNotNull(), c)
    return F.coalesce(valid(body), valid(inner))


def changed(payload: Column, path: str, value: Column | None = None) -> Column:
    """A JSON payload with the value at a dotted path written (given as JSON), or taken away; objects on the way are made."""

    @F.pandas_udf("string")
    def run(s: pd.Series, v: pd.Series) -> pd.Series:
        def one(x, y):
            root = parsed(x)
            if not isinstance(root, (dict, list)):
                return x
            *parents, last = path.split(".")
            node = root
            for p, following in zip(parents, [*parents[1:], last], strict=True):
                here = at_path(node, p)
                if not isinstance(here, (dict, list)):
                    if y is None:
                        return x
                    here = [] if following.isdigit() else {}
                    put(node, p, here)
                node = here
            if y is not None:
                put(node, last, parsed(y))
            elif isinstance(node, dict):
                node.pop(last, None)
            elif last.isdigit() and int(last) < len(node):
                del node[int(last)]
            return js(root)

        return pd.Series([one(x, y) for x, y in zip(s, v, strict=True)])

    def put(node, key, new):
        if isinstance(node, dict):
            node[key] = new
        else:
            node.extend([None] * (int(key) + 1 - len(node)))
            node[int(key)] = new

    return run(payload, value if value is not None else F.lit(None).cast("string"))


#: Where structured data keeps people.
PEOPLE_UNDER = ("founder", "founders", "employee", "employees", "member", "contactPoint", "@graph", "author", "publisher", "owner")


def json_ld_people(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, _ord, name, title, email, phone): people in the structured data of pages, to be held against names and roles by Column functions."""

    def people(node, depth=0):
        if depth > 6:
            return
        if isinstance(node, list):
            for x in node:
                yield from people(x, depth + 1)
        elif isinstance(node, dict):
            if "person" in str(node.get("@type", "")).lower() and isinstance(node.get("name"), str):
                yield tuple(x if isinstance(x := node.get(k), str) else None for k in ("name", "jobTitle", "email", "telephone"))
            for k in PEOPLE_UNDER:
                yield from people(node.get(k), depth + 1)

    def run(r):
        for i, (name, title, email, phone) in enumerate(people(parsed(r["block"]))):
            yield r["page_id"], r["pos"] * 1000 + i, name, title, (email or "").removeprefix("mailto:") or None, phone

    blocks = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    each = pages.select("page_id", F.posexplode(blocks).alias("pos", "block"))
    return _batched(each, run, "page_id long, _ord long, name string, title string, email string, phone string")
