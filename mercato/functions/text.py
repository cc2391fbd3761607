"""Name rules: product base names, categories, colours, sizes, ad-name parsing.

All rules are plain Spark string / array expressions (no Python UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercato.functions.core import col

# Fixed values that must equal the reference's vocabularies (natural order).
NO_CATEGORY = "Sin categoría"
SEPARATORS = [" - ", " | ", " / "]
COLOURS = ['negro', 'blanco', 'rojo', 'azul', 'verde', 'rosa', 'gris', 'beige',
           'marrón', 'marron', 'celeste', 'naranja', 'violeta', 'bordo', 'crudo',
           'natural', 'nude', 'camel', 'coral', 'fucsia', 'lila', 'mostaza',
           'terracota', 'turquesa', 'dorado', 'plateado', 'chocolate', 'arena',
           'hueso', 'salmón', 'salmon', 'oliva', 'tostado', 'aqua', 'ivory',
           'black', 'white', 'red', 'blue', 'green', 'pink', 'grey', 'gray',
           'brown', 'orange', 'purple', 'yellow', 'gold', 'silver']
SIZES = ['xxs', 'xs', 's', 'm', 'l', 'xl', 'xxl', 'xxxl', '2xl', '3xl',
         'unico', 'único', 'u', 'os', 'one size', 'free size',
         '34', '35', '36', '37', '38', '39', '40', '41', '42', '43', '44', '45', '46',
         '28', '29', '30', '31', '32', '33']
FORMAT_NORMALISE = {
    'ugc': 'UGC', 'estatico': 'Estático', 'static': 'Estático',
    'estático': 'Estático', 'video': 'Video', 'carrusel': 'Carrusel',
    'carousel': 'Carrusel', 'catálogo': 'Catálogo', 'catalogo': 'Catálogo',
    'catalog': 'Catálogo', 'colección': 'Colección', 'coleccion': 'Colección',
    'collection': 'Colección', 'imagen': 'Estático', 'image': 'Estático',
    'reel': 'Video', 'reels': 'Video', 'dpa': 'Catálogo',
}
STAGE_NORMALISE = {
    'tof': 'TOF', 'tofu': 'TOF', 'top': 'TOF', 'prospecting': 'TOF',
    'mof': 'MOF', 'mofu': 'MOF', 'mid': 'MOF', 'consideration': 'MOF',
    'bof': 'BOF', 'bofu': 'BOF', 'bot': 'BOF', 'retargeting': 'BOF',
    'ret': 'BOF', 'rmk': 'BOF', 'remarketing': 'BOF',
}
STAGE_TOKENS = ['TOF', 'MOF', 'BOF', 'TOFU', 'MOFU', 'BOFU']


def _map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def base_product(name) -> Column:
    """Drop a trailing parenthetical and keep the text before the first `` - ``."""
    n = F.trim(col(name))
    n = F.trim(F.regexp_replace(n, r"\s*\([^)]*\)\s*$", ""))
    return F.trim(F.substring_index(n, " - ", 1))


def category(name) -> Column:
    """Text before the first separator (in list order), else the first word."""
    n = F.trim(col(name))
    expr = None
    for sep in SEPARATORS:
        cond = F.instr(n, sep) > 0
        val = F.trim(F.substring_index(n, sep, 1))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    first_word = F.regexp_extract(n, r"^(\S+)", 1)
    expr = expr.when(first_word != "", first_word).otherwise(F.lit(NO_CATEGORY))
    return F.when(col(name).isNull(), F.lit(NO_CATEGORY)).otherwise(expr)


def variant_base(name) -> Column:
    """Text before the first separator (in list order), else the whole trimmed name."""
    n = col(name)
    expr = None
    for sep in SEPARATORS:
        cond = F.instr(n, sep) > 0
        val = F.trim(F.substring_index(n, sep, 1))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(F.trim(n))


def extract_color(name) -> Column:
    """First colour of the list that occurs as a whole word, capitalised."""
    tokens = F.split(F.lower(col(name)), r"\s+")
    # array_intersect keeps the order of its first argument: the first colour of the list wins
    hits = F.array_intersect(F.array(*[F.lit(c) for c in COLOURS]), tokens)
    return F.initcap(F.try_element_at(hits, F.lit(1)))


def extract_size(name, sku) -> Column:
    """First token of name + sku (split on space, dash, slash) that is a size, upper-cased."""
    combined = F.lower(F.concat_ws(" ", col(name), col(sku)))
    tokens = F.split(F.trim(F.regexp_replace(combined, "[-/]", " ")), r"\s+")
    # ordered by the tokens: the first token that is a size wins
    hits = F.array_intersect(tokens, F.array(*[F.lit(s) for s in SIZES]))
    return F.upper(F.try_element_at(hits, F.lit(1)))


# ----------------------------------------------------------- ad names

def _title(c: Column) -> Column:
    return F.initcap(c)


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def parse_name_standard(name) -> Column:
    """``Product | Format | Stage | Creator | Variation`` -> struct."""
    parts = F.transform(F.split(col(name), r"\|"), lambda p: F.trim(p))
    n = F.size(parts)

    def part(i):
        return F.when(n >= i, F.element_at(parts, i))

    fmt, stage = part(2), part(3)
    return F.struct(
        _nonempty(_title(part(1))).alias("product"),
        F.coalesce(_map_literal(FORMAT_NORMALISE)[F.lower(fmt)], fmt).alias("format"),
        F.coalesce(_map_literal(STAGE_NORMALISE)[F.lower(stage)], F.upper(stage)).alias("stage"),
        _nonempty(_title(part(4))).alias("creator"),
        _nonempty(part(5)).alias("variation"),
        col(name).alias("raw"),
    )


def parse_name_alternative(name) -> Column:
    """``Stage_Product_Format_Variation`` -> struct."""
    parts = F.split(col(name), "_")
    n = F.size(parts)

    def part(i):
        return F.when(n >= i, F.trim(F.element_at(parts, i)))

    stage, fmt = part(1), part(3)
    return F.struct(
        _title(F.regexp_replace(part(2), "-", " ")).alias("product"),
        F.coalesce(_map_literal(FORMAT_NORMALISE)[F.lower(fmt)], fmt).alias("format"),
        F.coalesce(_map_literal(STAGE_NORMALISE)[F.lower(stage)], F.upper(stage)).alias("stage"),
        F.lit(None).cast("string").alias("creator"),
        part(4).alias("variation"),
        col(name).alias("raw"),
    )


def parse_name(name, fmt) -> Column:
    """Dispatch on the detected naming format ('standard', 'alternative', else all-null fields)."""
    fmt = F.lit(fmt) if isinstance(fmt, str) else fmt
    empty = F.struct(*[F.lit(None).cast("string").alias(f)
                       for f in ("product", "format", "stage", "creator", "variation")],
                     col(name).alias("raw"))
    return (F.when(fmt == "standard", parse_name_standard(name))
            .when(fmt == "alternative", parse_name_alternative(name))
            .otherwise(empty))
