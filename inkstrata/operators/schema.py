"""Schemas of what is to be extracted: templates, coercion of answers by type, validation and repair.

A schema is a tree of fields. Over tables it becomes Column expressions: an
answer (JSON text) is parsed once with every leaf as text, coerced leaf by leaf
to the schema's Spark type, and checked; nothing leaves the JVM. The same rules
for single Python values serve the driver side and are what tests compare with.
"""

from __future__ import annotations

import datetime
import json
import re
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstrata.errors import SchemaError
from inkstrata.functions.text import let, to_bool, to_number, unfence

#: Names of types that a template may use -> kind.
KINDS = {"str": "str", "string": "str", "int": "int", "integer": "int", "float": "float", "number": "float", "bool": "bool", "boolean": "bool", "date": "date", "datetime": "datetime", "list": "list", "list[str]": "list", "object": "object"}
_SPARK = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampNTZType()}
_JSON = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "date": "string", "datetime": "string", "list": "array", "object": "object"}
BUILTIN = Path(__file__).resolve().parents[1] / "templates"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "str"
    required: bool = False
    default: Any = None
    description: str = ""
    item: Field | None = None  # of a list
    fields: tuple[Field, ...] = ()  # of an object
    aliases: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict, hash=False, compare=False)

    def spark(self) -> T.DataType:
        if self.kind == "list":
            return T.ArrayType((self.item or Field("item")).spark())
        return T.StructType([T.StructField(f.name, f.spark()) for f in self.fields]) if self.kind == "object" else _SPARK[self.kind]

    def text(self) -> T.DataType:
        """The type with every leaf as text."""
        if self.kind == "list":
            return T.ArrayType((self.item or Field("item")).text())
        return T.StructType([T.StructField(f.name, f.text()) for f in self.fields]) if self.kind == "object" else T.StringType()

    def json_schema(self) -> dict:
        out: dict[str, Any] = {"type": _JSON[self.kind]}
        if self.kind in ("date", "datetime"):
            out["format"] = "date-time" if self.kind == "datetime" else "date"
        if self.description:
            out["description"] = self.description
        if self.kind == "list":
            out["items"] = (self.item or Field("item")).json_schema()
        if self.kind == "object":
            out |= {"properties": {f.name: f.json_schema() for f in self.fields}, "required": [f.name for f in self.fields if f.required]}
        return out


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[Field, ...]
    description: str = ""
    version: str = "1.0"

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def __getitem__(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def root(self) -> Field:
        return Field(self.name, "object", fields=self.fields)

    def struct(self) -> T.StructType:
        return self.root().spark()  # type: ignore[return-value]

    def json_schema(self) -> dict:
        return {"title": pascal(self.name), **self.root().json_schema()}


def pascal(name: str) -> str:
    """``line_item`` -> ``LineItem``."""
    return "".join(w.capitalize() for w in name.split("_"))


def unwrapped(kinds: list[str | None]) -> str | None:
    """The one kind of a union with nothing else but null; None if there are several."""
    some = [k for k in kinds if k not in (None, "null", "None")]
    return some[0] if len(some) == 1 else None


def field_of(name: str, spec: Any) -> Field:
    """A field of a template; a type that is no name of one is text, a plain value means required text."""
    if not isinstance(spec, dict):
        return Field(name, required=True)
    kind = spec.get("type", "str")
    if isinstance(kind, list):
        kind = unwrapped(kind) or "str"
    kind = KINDS.get(kind, "str")
    item = None
    if kind == "list":
        item = field_of("item", {"type": "object", "fields": spec["item_fields"]}) if spec.get("item_fields") else field_of("item", {"type": spec.get("item_type", "str")})
    own = tuple(field_of(n, s) for n, s in spec.get("fields", {}).items()) if kind == "object" else ()
    names = [name, *(spec[k] for k in ("alias", "serialization_alias", "validation_alias", "pdf_field", "form_field") if isinstance(spec.get(k), str))]
    more = spec.get("pdf_fields", [])
    names += [more] if isinstance(more, str) else [x for x in more if isinstance(x, str)]
    required = bool(spec.get("required", False))
    return Field(name, kind, required, spec.get("default"), spec.get("description", ""), item, own, tuple(dict.fromkeys(names)), {k: v for k, v in spec.items() if k in ("pdf_field", "form_field", "pdf_fields", "placement")})


def schema_of(data: dict | str) -> Schema:
    """From a template as mapping or YAML text."""
    if isinstance(data, str):
        import yaml

        data = yaml.safe_load(data)
    if not isinstance(data, dict) or not isinstance(data.get("fields", {}), dict):
        raise SchemaError("a template is a mapping with fields")
    return Schema(data.get("name", "document"), tuple(field_of(n, s) for n, s in data.get("fields", {}).items()), data.get("description", ""), str(data.get("version", "1.0")))


class Registry:
    """Templates of several folders: of equal names the first folder's counts, unreadable files are left out of lists."""

    def __init__(self, folders: list[str | Path] | None = None):
        self.folders = [Path(f) for f in (folders if folders is not None else ["inkstrata_templates", Path.home() / ".inkstrata" / "templates", BUILTIN])]

    def _files(self, folder: Path) -> list[Path]:
        return [*sorted(folder.glob("*.yaml")), *sorted(folder.glob("*.yml"))] if folder.is_dir() else []

    def raw(self, name: str) -> dict:
        import yaml

        for folder in self.folders:
            for path in (folder / f"{name}.yaml", folder / f"{name}.yml"):
                if path.is_file():
                    data = yaml.safe_load(path.read_text(encoding="utf-8"))
                    if not isinstance(data, dict):
                        raise SchemaError(f"{path} is no template")
                    return data
        raise FileNotFoundError(f"there is no template {name!r}")

    def load(self, name: str) -> Schema:
        return schema_of(self.raw(name))

    def list(self) -> list[dict]:
        import yaml

        out: dict[str, dict] = {}
        for folder in self.folders:
            for path in self._files(folder):
                if path.stem in out:
                    continue
                try:
                    data = yaml.safe_load(path.read_text(encoding="utf-8"))
                    out[path.stem] = {"name": data.get("name", path.stem), "version": str(data.get("version", "0.0")), "description": data.get("description", ""), "source": "builtin" if folder == BUILTIN else "user", "path": str(path)}
                except (OSError, yaml.YAMLError, AttributeError):
                    continue
        return list(out.values())

    def save(self, name: str, data: dict, folder: str | Path | None = None) -> Path:
        import yaml

        path = Path(folder or self.folders[0]) / f"{name}.yaml"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(yaml.safe_dump(data, sort_keys=False), encoding="utf-8")
        return path


# --- single values --------------------------------------------------------------------------


def number_of(value: object, kind: str) -> object:
    """The number in a text; anything else stays as it is."""
    if not isinstance(value, str) or not value.strip():
        return value
    s = value.strip()
    m = re.search(r"[-+]?\d+(?:\.\d+)?", s.strip("()").translate(str.maketrans("", "", ",$€£¥%")).strip())
    if not m:
        return value
    n = float(m.group())
    n = -abs(n) if s.startswith("(") and s.endswith(")") else n
    return int(n) if kind == "int" else n


def coerce_value(f: Field, value: object) -> object:
    """A value brought to the field's kind where that is possible, else as it is."""
    if value is None:
        return None
    if f.kind in ("int", "float"):
        return number_of(value, f.kind)
    if f.kind == "bool" and isinstance(value, str):
        return {"true": True, "yes": True, "y": True, "1": True, "false": False, "no": False, "n": False, "0": False}.get(value.strip().lower(), value)
    if f.kind == "list":
        item = f.item or Field("item")
        if isinstance(value, list):
            return [coerce_value(item, v) for v in value]
        return [value] if isinstance(value, str) and item.kind == "str" else value
    if f.kind == "object" and isinstance(value, dict):
        return value | {g.name: coerce_value(g, value[g.name]) for g in f.fields if g.name in value}
    return value


def faults(f: Field, value: object, path: str = "") -> list[str]:
    """Why a coerced value does not fit its field; empty if it does."""
    at = path or f.name
    if value is None:
        return [f"{at}: missing"] if f.required else []
    ok = {
        "str": isinstance(value, str), "int": isinstance(value, int) and not isinstance(value, bool), "float": isinstance(value, (int, float)) and not isinstance(value, bool), "bool": isinstance(value, bool),
        "list": isinstance(value, list), "object": isinstance(value, dict),
    }.get(f.kind)
    if f.kind in ("date", "datetime"):
        try:
            ok = bool((datetime.date if f.kind == "date" else datetime.datetime).fromisoformat(str(value)))
        except ValueError:
            ok = False
    if not ok:
        return [f"{at}: not a {f.kind}"]
    if f.kind == "list":
        return [x for k, v in enumerate(value) for x in faults(replace(f.item or Field("item"), required=True), v, f"{at}[{k}]")]
    if f.kind == "object":
        return [x for g in f.fields for x in faults(g, value.get(g.name, g.default), f"{at}.{g.name}")]
    return []


def validate(schema: Schema, data: object) -> tuple[dict, list[str]]:
    """Coerced data with defaults, and what is wrong with them."""
    if not isinstance(data, dict):
        return {}, ["the answer is no object"]
    out = {f.name: coerce_value(f, data[f.name]) if f.name in data else f.default for f in schema.fields}
    return out, [x for f in schema.fields for x in faults(f, out[f.name])]


def fallback(schema: Schema, data: object) -> dict | None:
    """The data with unusable lists emptied, None if that changes nothing; scalars are never made up."""
    if not isinstance(data, dict):
        return None
    out, _ = validate(schema, data)
    bad = [f.name for f in schema.fields if f.kind == "list" and not isinstance(out[f.name], list) and (f.name in data or not f.required)]
    return out | dict.fromkeys(bad, []) if bad else None


def leaf_strings(value: object) -> list[str]:
    """The texts in a value, depth first; nulls, booleans and blanks are left out."""
    if value is None or isinstance(value, bool):
        return []
    if isinstance(value, dict):
        return [x for v in value.values() for x in leaf_strings(v)]
    if isinstance(value, (list, tuple, set)):
        return [x for v in value for x in leaf_strings(v)]
    return [s] if (s := str(value).strip()) else []


# --- columns --------------------------------------------------------------------------------


def _leaf(f: Field, raw: Column) -> Column:
    if f.kind == "float":
        return to_number(raw)
    if f.kind == "int":
        return to_number(raw).try_cast("bigint")
    if f.kind == "bool":
        return to_bool(raw)
    if f.kind == "date":
        return raw.try_cast("date")
    if f.kind == "datetime":
        return raw.try_cast("timestamp_ntz")
    return raw


def _coerced(f: Field, raw: Column) -> Column:
    if f.kind == "list":
        item = f.item or Field("item")
        return F.transform(raw, lambda x: _coerced(item, x))
    if f.kind == "object":
        return F.when(raw.isNotNull(), F.struct(*[_coerced(g, raw[g.name]).alias(g.name) for g in f.fields]))
    return _leaf(f, raw)


def coerce_answer(schema: Schema, answer: Column) -> Column:
    """struct<data, faults> of a JSON answer, fenced or not: the typed values and, per field, what does not fit.

    A bare text for a list of texts becomes a list of one. An answer that is no
    object has null data and one fault.
    """
    wide = T.StructType([T.StructField(f.name, f.text()) for f in schema.fields])
    bare_list = lambda f: f.kind == "list" and (f.item or Field("item")).kind == "str"

    def typed(p: Column) -> Column:
        values = []
        for f in schema.fields:
            given, x = p["whole"][F.lit(f.name)], p["raw"][f.name]
            if bare_list(f):
                bare = given.isNotNull() & ~F.startswith(F.trim(given), F.lit("["))
                x = F.when(bare, F.array(given)).otherwise(x)
            v = _coerced(f, x)
            if f.default is not None:
                v = F.coalesce(v, F.lit(f.default).cast(f.spark()))
            values.append(v.cast(f.spark()).alias(f.name))
        return let(F.struct(*values), lambda d: judged(p, d))

    def judged(p: Column, d: Column) -> Column:
        given = lambda f: p["whole"][F.lit(f.name)].isNotNull()
        wrong = [F.when(d[f.name].isNull() & given(f), F.lit(f"{f.name}: not a {f.kind}")).when(d[f.name].isNull() & F.lit(f.required), F.lit(f"{f.name}: missing")) for f in schema.fields]
        found = F.filter(F.array(*wrong), lambda x: x.isNotNull())
        return F.struct(F.when(p["ok"], d).alias("data"), F.when(p["ok"], found).otherwise(F.array(F.lit("the answer is no object"))).alias("faults"))

    def parsed(text: Column) -> Column:
        """The text read once as a struct and once as a map, which every field then looks into."""
        both = F.struct(text.alias("text"), F.from_json(text, wide).alias("raw"), F.from_json(text, "map<string, string>").alias("whole"))
        return let(both, lambda b: F.struct(b["raw"].alias("raw"), b["whole"].alias("whole"), F.coalesce(F.startswith(F.trim(b["text"]), F.lit("{")) & b["whole"].isNotNull(), F.lit(False)).alias("ok")))

    return let(unfence(answer), lambda text: let(parsed(text), typed))


def emptied(schema: Schema, data: Column) -> Column:
    """The typed data with every null list as an empty one: the last resort of a repair."""
    return F.struct(*[(F.coalesce(data[f.name], F.array().cast(f.spark())) if f.kind == "list" else data[f.name]).alias(f.name) for f in schema.fields])


def repair(answers: DataFrame, schema: Schema, again: DataFrame | None = None, column: str = "answer", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, data, faults, source (``first``, ``repaired``, ``fallback`` or ``failed``) of every answer.

    ``again``: keys and ``answer`` of second answers, asked for only where the first does not fit. Only ids and answers are joined.
    """
    keys = list(keys)
    first = answers.select(*keys, coerce_answer(schema, F.col(column)).alias("one"))
    if again is None:
        both = first.withColumn("two", F.lit(None).cast(first.schema["one"].dataType))
    else:
        both = first.join(again.select(*keys, coerce_answer(schema, F.col("answer")).alias("two")), keys, "left")
    good = lambda c: F.col(f"{c}.data").isNotNull() & (F.size(f"{c}.faults") == 0)
    lists = [f.name for f in schema.fields if f.kind == "list"]
    only_lists = F.forall("one.faults", lambda x: F.exists(F.array(*[F.lit(n) for n in lists]), lambda n: F.startswith(x, F.concat(n, F.lit(":"))))) if lists else F.lit(False)
    saved = F.col("one.data").isNotNull() & only_lists
    source = F.when(good("one"), "first").when(F.coalesce(good("two"), F.lit(False)), "repaired").when(saved, "fallback").otherwise("failed")
    data = F.when(source == "first", F.col("one.data")).when(source == "repaired", F.col("two.data")).when(source == "fallback", emptied(schema, F.col("one.data")))
    return both.select(*keys, data.alias("data"), F.when(source == "failed", F.col("one.faults")).otherwise(F.array().cast("array<string>")).alias("faults"), source.alias("source"))


def split(schema: Schema, shards: int) -> list[Schema]:
    """Schemas of contiguous groups of ceil(n / shards) fields; the schema itself where that helps nothing."""
    n = len(schema.fields)
    if shards <= 1 or n < 2:
        return [schema]
    size = -(-n // min(shards, n))
    return [Schema(f"{schema.name}_shard{k + 1}", schema.fields[a : a + size], schema.description, schema.version) for k, a in enumerate(range(0, n, size))]


# --- discovery ------------------------------------------------------------------------------


def discovered(answer: str) -> tuple[Schema, str]:
    """The schema that a model's list of fields describes, and its template as YAML; fields without a name are left out."""
    import yaml

    text = answer.strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[-1].rsplit("```", 1)[0].strip()
    try:
        data = json.loads(text)
    except json.JSONDecodeError as e:
        raise SchemaError(f"the description of fields is no JSON: {e}") from e
    name = data.get("document_type") or "document"
    specs: dict[str, dict] = {}
    for f in data.get("fields", []):
        if f.get("name"):
            kind = f.get("type", "str")
            specs[f["name"]] = {"type": kind if kind in ("str", "int", "float", "bool", "date") else "str", "required": bool(f.get("required", True))} | ({"description": f["description"]} if f.get("description") else {})
            if kind in ("list", "list[str]"):
                specs[f["name"]] |= {"type": "list", "item_type": "str"}
    template = {"name": name, "version": "1.0", "description": data.get("description", ""), "fields": specs}
    return schema_of(template), yaml.safe_dump(template, sort_keys=False, allow_unicode=True)
