"""Plan documents as JSON text, checked before the schema: what is missing, what is null and what has the wrong type.

The text is parsed to VARIANT, where the three differ; a declared schema turns all of them into null.  What a field
must be comes from the same declared types.  Only documents without such errors are read by the schema and held
against the rules on values and structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.plans import DDL
from .validation import COLLECTIONS, field_errors, structural_errors

# Fields that must be there; all others may be absent.
REQUIRED = {
    "rooms": ("id", "name", "polygon"), "walls": ("id", "start", "end"), "doors": ("id", "wall_id", "position", "width"), "windows": ("id", "wall_id", "position", "width"),
    "stairs": ("id", "polygon"), "dimensions": ("id", "start", "end", "value"), "furniture": ("id", "furniture_type", "position"),
}
# Fields that may be absent but not null, as they have a default.
NEVER_NULL = ("units", *COLLECTIONS, "source", "metadata", "wall_type", "rotation", "extra")
# What a value's type, as ``schema_of_variant`` names it, must look like, and what else it is called.
FITS = {"string": ("^STRING$", "text"), "double": ("^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "a number"), "int": ("^BIGINT$", "a whole number"), "array": ("^ARRAY", "a list"), "struct": ("^OBJECT", "an object"), "map": ("^OBJECT", "an object")}


def _fields(t: T.StructType, needed: tuple, above: str = "") -> list[str]:
    """What each field of a struct, and of the structs in it, must be, as SQL structs; inner fields count only where the outer one is an object."""
    out = []
    for f in t.fields:
        kind = f.dataType.simpleString().split("<")[0]
        fits, noun = FITS[kind]
        required, nullable = f.name in needed, f.name not in (*needed, *NEVER_NULL)
        out.append(f"struct('{above}{f.name}' AS name, '{above.removesuffix('.')}' AS above, '{fits}' AS fits, '{noun}' AS noun, {required} AS required, {nullable} AS nullable)")
        if kind == "struct":
            out += _fields(f.dataType, ("x", "y"), f"{above}{f.name}.")
    return out


def _told(shape: str, loc: str, fits: str, noun: str, required: str, nullable: str) -> str:
    """One error or null, by the type of a value; null for a value that is missing."""
    return f"CASE WHEN {shape} IS NULL THEN IF({required}, {loc} || ': missing', NULL) WHEN {shape} = 'VOID' THEN IF({nullable}, NULL, {loc} || ': null') WHEN NOT {shape} RLIKE {fits} THEN {loc} || ': not ' || {noun} END"


def _shape(value: str, path: str) -> str:
    return f"schema_of_variant(try_variant_get({value}, {path}, 'variant'))"


def _object(value: str, loc: str, fields: list[str]) -> str:
    """The errors of the fields of an object."""
    own = _told("s", f"{loc} || '.' || f.name", "f.fits", "f.noun", "f.required", "f.nullable").replace("'' || '.' || ", "")
    counts = f"f.above = '' OR coalesce({_shape(value, chr(39) + '$.' + chr(39) + ' || f.above')} LIKE 'OBJECT%', false)"
    shape = _shape(value, "'$.' || f.name")
    return f"filter(transform(array({', '.join(fields)}), f -> IF({counts}, transform(array({shape}), s -> {own})[0], NULL)), e -> e IS NOT NULL)"


def _items(value: str, path: str) -> str:
    return f"coalesce(try_variant_get({value}, '$.{path}', 'array<variant>'), cast(array() AS array<variant>))"


def _list(value: str, path: str, loc: str, item, k: str) -> str:
    """The errors of the objects of a list; one that is no object has that error alone."""
    here = f"{loc} || cast({k}i AS string)"
    own = f"IF(schema_of_variant({k}) LIKE 'OBJECT%', {item(k, here)}, array({here} || IF(schema_of_variant({k}) = 'VOID', ': null', ': not an object')))"
    return f"flatten(transform({_items(value, path)}, ({k}, {k}i) -> {own}))"


def shape_errors(document: str) -> Column:
    """The errors of a document (a VARIANT column) against the declared types: paths with what is wrong, lists after the plain fields."""
    whole = T.StructType.fromDDL(DDL)
    parts = [_object(document, "''", _fields(whole, ("project_id",)))]
    for f in whole.fields:
        if f.name in COLLECTIONS:
            element = f.dataType.elementType

            def item(e, loc, element=element, needed=REQUIRED[f.name]):
                own = _object(e, loc, _fields(element, needed))
                if "polygon" not in element.names:
                    return own
                corner = _fields(element["polygon"].dataType.elementType, ("x", "y"))
                return f"concat({own}, {_list(e, 'polygon', loc + ' || ' + chr(39) + '.polygon.' + chr(39), lambda p, at: _object(p, at, corner), 'p')})"

            parts.append(_list(document, f.name, f"'{f.name}.'", item, "e"))
    return F.expr(f"concat({', '.join(parts)})")


def checked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``document`` (by the schema; null unless valid) and ``errors`` of their floorplan_data.

    Text that is no JSON object has the one error ``document: not an object``."""
    fields = [f.name for f in T.StructType.fromDDL(DDL).fields]
    if taken := {*fields, "document", "errors", "_v", "_s", "_d", "_f"} & set(rows.columns):
        raise ValueError(f"columns exist already: {sorted(taken)}")
    v = F.try_parse_json("floorplan_data")
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    out = rows.withColumn("_v", v).withColumn("_s", F.when(is_object, shape_errors("_v")).otherwise(F.array(F.lit("document: not an object"))))
    typed = out.withColumn("_d", F.when(F.size("_s") == 0, F.from_json("floorplan_data", DDL)))
    wide = typed.select(*rows.columns, "_s", "_d", *[F.col("_d")[n].alias(n) for n in fields])
    value = F.when(F.size("_f") > 0, F.col("_f")).otherwise(structural_errors())
    wide = wide.withColumn("_f", F.when(F.col("_d").isNotNull(), field_errors()).otherwise(F.array().cast("array<string>")))
    wide = wide.withColumn("errors", F.when(F.size("_s") > 0, F.col("_s")).otherwise(value))
    return wide.select(*rows.columns, F.when(F.size("errors") == 0, F.col("_d")).alias("document"), "errors")


def parsed(rows: DataFrame) -> DataFrame:
    """``rows`` with their valid document; the job fails at one that is not, with its errors."""
    told = checked(rows)
    fails = F.raise_error(F.concat(F.lit("Invalid plan document: "), F.array_join("errors", "; "))).cast(told.schema["document"].dataType)
    return told.select(*rows.columns, F.when(F.size("errors") > 0, fails).otherwise(F.col("document")).alias("document"))
