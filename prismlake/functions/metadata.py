"""Metadata: text, tags and maps as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of each tag type, by its number.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}


def until_nul(s: Column) -> Column:
    return F.substring_index(s, "\0", 1)


def without_prefix(s: Column, prefix: str) -> Column:
    return F.when(s.startswith(prefix), F.substring(s, len(prefix) + 1, 1 << 20)).otherwise(s)


def cfa_text(pattern: Column) -> Column:
    """First letters of the colour names, in order."""
    return F.array_join(F.transform(pattern, lambda c: F.substring(c, 1, 1)), "")


def exposure_text(seconds: Column) -> Column:
    """Whole seconds as they are, shorter times as a fraction."""
    return F.when(seconds >= 1, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(F.concat(F.lit("1/"), F.round(F.lit(1.0) / seconds).cast("long").cast("string"), F.lit("s")))


def gps_text(degrees: Column, ref: Column) -> Column:
    d = lambda k: degrees[k].cast("string")
    return F.concat(d(0), F.lit("°"), d(1), F.lit("'"), d(2), F.lit('"'), ref)


def altitude(value: Column, ref: Column) -> Column:
    """Reference 1 is below sea level."""
    return F.when(ref == 1, -value).otherwise(value)


def elapsed_text(ms: Column) -> Column:
    return F.concat(F.floor(ms / 1000).cast("string"), F.lit("s "), (ms % 1000).cast("string"), F.lit("ms"))


def tag_text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), " ")


def digit_fold(s: Column) -> Column:
    """A serial number from text: digits count as such, other characters by their code modulo 10."""
    code = lambda c: F.ascii(c)
    digit = lambda c: F.when((code(c) >= 48) & (code(c) <= 57), code(c) - 48).otherwise(code(c) % 10)
    return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise((a * 10 + digit(c)).bitwiseAND(0xFFFFFFFF)))


def rotation(orientation: Column, alternate: Column) -> Column:
    """Quarter turns from the orientation tag, or else from the alternate one."""
    main = F.when(orientation.isin(2, 3), 2).when(orientation.isin(5, 6), 1).when(orientation.isin(7, 8), 3).otherwise(0)
    other = F.when(alternate.isin(2, 3), 2).when(alternate.isin(4, 6), 1).when(alternate.isin(5, 7), 3).otherwise(0)
    return F.when(orientation.isNotNull(), main).otherwise(other)


def chromaticity_gains(x: Column, y: Column) -> list[Column]:
    """White-balance gains from a white point in x, y; z is what is left to 1."""
    z = F.lit(1.0) - x - y
    return [F.when(c != 0, F.lit(1.0) / c) for c in (x, y, z)]


def normalised_gains(r: Column, g: Column, b: Column) -> list[Column]:
    """Gains relative to green; null if any is 0."""
    ok = (r != 0) & (g != 0) & (b != 0)
    return [F.when(ok, c / g.cast("double")) for c in (r, g, b)]


def unsigned(data: Column, at: int | Column, size: int, little: bool) -> Column:
    """Whole number of `size` bytes at an offset of binary data (2 to 8 bytes, below 2^63)."""
    start = (F.lit(at) if isinstance(at, int) else at) + 1
    digits = F.hex(F.substring(data, start, F.lit(size)))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.conv(digits, 16, 10).cast("long")


def magic(data: Column) -> Column:
    """Container format by the first bytes."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("49492A00"), "TIFF little").when(head.startswith("4D4D002A"), "TIFF big").when(head.startswith("49495500"), "Panasonic").when(head.startswith("49495253") | head.startswith("4949524F"), "Olympus")
        .when(head.startswith("46554A4946494C4D"), "Fuji").when(head.startswith("004D524D"), "Minolta").when(head.startswith("FFD8FF"), "JPEG").when(head.startswith("89504E47"), "PNG").when(head.startswith("424D"), "BMP").when(head.startswith("47494638"), "GIF")
        .otherwise("unknown")
    )


#: Readable file extensions and the decoder of each.
EXTENSIONS = {
    "TIFF": ["tif", "tiff"], "JPEG": ["jpg", "jpeg"], "bitmap": ["png", "jxr", "ico", "bmp", "gif"], "DNG": ["dng"], "NEF": ["nef"], "CR2": ["cr2"], "ARW": ["arw", "srf", "sr2"],
    "PEF": ["pef"], "ORF": ["orf"], "RW2": ["rw2", "raw"], "RAF": ["raf"],
}


def decoder(path: Column) -> Column:
    """Decoder by the file's extension, whatever its case; null if none reads it."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = None
    for name, known in EXTENSIONS.items():
        out = F.when(ext.isin(known), name) if out is None else out.when(ext.isin(known), name)
    return out


def exif_rows(images: DataFrame) -> DataFrame:
    """(image_id, grp, name, data, ord): the non-empty fields of each image, in a fixed order."""
    text = lambda c: F.col(c).cast("string")
    fields = [
        ("Parser", "File", text("file")), ("Camera", "Dimension", F.concat(text("width"), F.lit(" x "), text("height"))), ("Image", "Color depth", F.concat(text("depth"), F.lit(" bits"))),
        ("Camera", "Maker", text("make")), ("Camera", "Model", text("model")), ("Shot", "ISO", F.when(F.col("iso") > 0, text("iso"))), ("Shot", "Exposure time", F.when(F.col("exposure") > 0, exposure_text(F.col("exposure")))),
        ("Lens", "Lense", text("lens")), ("Lens", "Focal", F.when(F.col("focal") > 0, F.concat(F.col("focal").cast("int").cast("string"), F.lit(" mm")))), ("Various", "Time of capture", text("time_take")),
    ]
    rows = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(n).alias("name"), d.alias("data"), F.lit(i).alias("ord")) for i, (g, n, d) in enumerate(fields)])
    return images.select("image_id", F.inline(rows)).where("data IS NOT NULL AND data <> ''")


def exif_groups(rows: DataFrame) -> DataFrame:
    """(image_id, grp, fields): each group's fields in their order."""
    return rows.groupBy("image_id", "grp").agg(F.expr("transform(array_sort(collect_list(struct(ord, name, data))), f -> concat(f.name, ': ', f.data))").alias("fields"))


def small_float(h: Column, exponent: int, mantissa: int) -> Column:
    """A short float as a double; infinities and what isn't a number are null."""
    e, m = F.shiftright(h, mantissa).bitwiseAND((1 << exponent) - 1), h.bitwiseAND((1 << mantissa) - 1)
    sign = F.when(F.shiftright(h, mantissa + exponent).bitwiseAND(1) == 1, -1).otherwise(1)
    bias = (1 << (exponent - 1)) - 1
    normal = sign * (m + (1 << mantissa)) * F.pow(F.lit(2.0), e - (bias + mantissa))
    return F.when(e == (1 << exponent) - 1, None).when(e == 0, sign * m * F.lit(2.0 ** (1 - bias - mantissa))).otherwise(normal)
