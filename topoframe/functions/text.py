"""Column expressions for tagged model output: attributes, names, boxes, points, slugs, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tag shapes of the text format. A body holds neither '>' nor '/', so such names lose their tag.
ATTRIBUTE = r'(?U)(\w+)="([^"]*)"'
NODE_TAG = r"<NODE\s+([^>/]+?)/>"
TRACE_TAG = r"<TRACE\s+([^>/]*?)/>"
LINK_TAG = r"(?s)<(TRACE|EDGE)\s+([^>/]*?)/>"
BLOCK = r"(?s)<CHECK_NODE\s+([^>]*)>(.*?)(?=<CHECK_NODE\s+|</EDGE_GRAPH>|$)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def groups(text: Column | str, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group))


def parse_attrs(fragment: Column | str) -> Column:
    """map of every name="value"; of a repeated name the last value counts, whatever the session's map policy."""
    once = F.array(F.struct(groups(fragment, ATTRIBUTE, 1).alias("keys"), groups(fragment, ATTRIBUTE, 2).alias("values")))  # named in a lambda, each would be searched again per attribute

    def pairs(found: Column) -> Column:
        keys, values = found["keys"], found["values"]
        named = F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.get(values, i).alias("value"), i.alias("at")))
        return F.filter(named, lambda p: F.array_position(F.reverse(keys), p["key"]) == F.size(keys) - p["at"])

    return F.map_from_entries(F.transform(F.flatten(F.transform(once, pairs)), lambda p: F.struct(p["key"], p["value"])))


def normalize_name(name: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col(name), F.lit(""))), "[^a-z0-9]", "")


def _numbers(json: Column, size: int) -> Column:
    """A JSON list of ``size`` numbers (quoted ones too), else null; anything after the list makes it invalid."""
    items = F.from_json(json, "array<string>")
    numbers = F.transform(items, lambda x: x.try_cast("double"))
    good = json.rlike(r"(?s)^\s*\[.*\]\s*$") & (F.size(items) == size) & ~F.exists(numbers, lambda x: x.isNull())
    return F.when(good, numbers)


def parse_box(value: Column | str) -> Column:
    """Four numbers, else an empty array."""
    return F.coalesce(_numbers(F.coalesce(col(value), F.lit("[]")), 4), F.array().cast("array<double>"))


def parse_points(value: Column | str, exact: bool = True) -> Column:
    """Five points or null. exact: each has two numbers; else the first two of at least two, which must be finite."""
    json = col(value)
    items = F.from_json(json, "array<array<string>>")
    points = F.transform(items, lambda p: F.transform(F.slice(p, 1, 2), lambda x: x.try_cast("double")))
    size_ok = (lambda p: F.size(p) == 2) if exact else (lambda p: F.size(p) >= 2)
    number_ok = (lambda x: x.isNotNull()) if exact else (lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = json.rlike(r"(?s)^\s*\[.*\]\s*$") & (F.size(items) == 5) & F.forall(items, size_ok) & F.forall(points, lambda p: F.forall(p, number_ok))
    return F.when(F.coalesce(good, F.lit(False)), points)


def arrow_kind(attrs: Column) -> Column:
    has = lambda k: F.map_contains_key(attrs, k)
    return F.when(has("arrow_start") & has("arrow_end"), "both").when(has("arrow"), "end").otherwise("none")


def sample_stem(sample_id: Column | str) -> Column:
    return F.substring_index(col(sample_id), "_edge_trace5_typed_", 1)


def sample_key(unified: Column | str, plain: Column | str) -> Column:
    """The first non-empty id; neither is an error."""
    key = F.coalesce(F.nullif(col(unified), F.lit("")), F.nullif(col(plain), F.lit("")))
    return F.when(key.isNotNull(), key).otherwise(F.raise_error(F.lit("row has neither unified_sample_id nor sample_id")))


def first_filled(*columns: Column | str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in columns))


def slugify(label: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(col(label))), "[^a-z0-9]+", "_"), F.lit("_"))


#: Labels whose assets go by another name.
SLUG_ALIASES = {"bear": "black_bear", "wolf": "gray_wolf"}


def label_slug(label: Column | str) -> Column:
    slug = slugify(label)
    out = slug
    for plain, alias in SLUG_ALIASES.items():
        out = F.when(slug == plain, alias).otherwise(out)
    return out


def display_case(label: Column | str, pick: Column) -> Column:
    """Upper, lower, title or the source's own casing, by a number from 0 to 3."""
    c = col(label)
    return F.when(pick == 0, F.upper(c)).when(pick == 1, F.lower(c)).when(pick == 2, F.initcap(c)).otherwise(c)


def truncate_at(text: Column | str, *stops: str) -> Column:
    """Text up to and with the first stop tag; without any, all of it."""
    c = col(text)
    ends = [F.when(F.instr(c, s) > 0, F.instr(c, s) + len(s) - 1) for s in stops]
    return F.substring(c, F.lit(1), F.coalesce(F.array_min(F.array(*ends)), F.length(c)))


def variant_number(file: Column | str) -> Column:
    return F.regexp_extract(col(file), r"_(\d+)\.[^.]+$", 1).try_cast("int")


def resolve_path(path: Column | str, root: str) -> Column:
    c = col(path)
    return F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), c))


def module_family(name: Column | str) -> Column:
    """vision, bridge or text, by a module's dotted name; heads that are never adapted are 'blocked'."""
    c = col(name)
    leaf = F.substring_index(c, ".", -1)
    return F.when(leaf.isin("lm_head", "output_layer"), "blocked").when(c.startswith("model.visual.") & c.contains(".merger"), "bridge").when(c.startswith("model.visual."), "vision").otherwise("text")


def parse_counts(spec: str) -> dict[str, dict[str, int]]:
    """'train:simple=1,medium=2;test:simple=3' as nested counts."""
    out: dict[str, dict[str, int]] = {}
    for part in filter(None, (p.strip() for p in spec.split(";"))):
        split, _, rest = part.partition(":")
        out[split.strip()] = {k.strip(): int(v) for k, _, v in (item.partition("=") for item in rest.split(",") if item.strip())}
    return out


def simple_yaml(text: str) -> dict:
    """Indented mappings with scalar strings; comments and quotes go."""
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].rstrip()
        if not line.strip() or ":" not in line:
            continue
        depth = len(line) - len(line.lstrip())
        key, _, value = line.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        value = value.strip().strip("\"'")
        if value:
            stack[-1][1][key.strip()] = value
        else:
            child: dict = {}
            stack[-1][1][key.strip()] = child
            stack.append((depth, child))
    return root
