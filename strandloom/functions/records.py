"""Column expressions over variant records: lists, INFO, FORMAT, genotypes, ranges and predicates.

Records have the columns ``chrom, pos, id, ref, alt, qual, filter, info, format, sample``; ``alt, filter, info, format``
and ``sample`` are string arrays, empty where the file has ``.``. All expressions are built-in functions of the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty() -> Column:
    return F.array().cast("array<string>")


def listed(text: Column | str, separator: str) -> Column:
    """A delimited field as an array; missing, empty and ``.`` are the empty array."""
    text = _col(text)
    return F.when(text.isNull() | text.isin("", "."), empty()).otherwise(F.split(text, separator))


def unlisted(items: Column | str, separator: str) -> Column:
    """The text of an array field, ``.`` if it is empty."""
    items = _col(items)
    return F.when(F.size(items) > 0, F.array_join(items, separator)).otherwise(F.lit("."))


# Numbers. A prefix is parsed as the number and the rest ignored; the strict forms refuse a rest.


def parse_double(text: Column | str) -> Column:
    """The number that a text begins with, or null."""
    return F.regexp_extract(_col(text), r"^\s*([+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[iI]nf(?:inity)?|[nN]a[nN]))", 1).try_cast("double")


def parse_double_strict(text: Column | str) -> Column:
    text = _col(text)
    return F.when(text.rlike(r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[iI]nf(?:inity)?|[nN]a[nN])$"), parse_double(text))


def parse_int(text: Column | str) -> Column:
    """The signed 32-bit integer that a text begins with; null if there is none or it doesn't fit."""
    found = F.regexp_extract(_col(text), r"^\s*([+-]?\d+)", 1).try_cast("long")
    return F.when(found.between(-(2**31), 2**31 - 1), found).cast("int")


def parse_long(text: Column | str) -> Column:
    return F.regexp_extract(_col(text), r"^\s*([+-]?\d+)", 1).try_cast("long")


def parse_unsigned(text: Column | str) -> Column:
    """As :func:`parse_int` for unsigned 32-bit numbers; a minus sign is no number."""
    found = F.regexp_extract(_col(text), r"^\s*[+]?(\d+)", 1).try_cast("long")
    return F.when(found.between(0, 2**32 - 1), found)


def strict(parse, text: Column | str) -> Column:
    """An integer parser's result if the whole text is the number."""
    text = _col(text)
    return F.when(text.rlike(r"^\s*[+-]?\d+$"), parse(text))


def required(value: Column, what: str, text: Column | str) -> Column:
    """``value``, or an error that names the text it should have come from."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"can't parse {what} from '"), F.coalesce(_col(text), F.lit("")), F.lit("'"))))


def round_half_away(value: Column | str) -> Column:
    """To the nearest integer, halves away from zero, as a double."""
    return F.round(_col(value).cast("double"), 0)


def maybe_double(text: Column | str) -> Column:
    """A number that may be missing: null for null, the empty text and ``.``, none of which a number begins."""
    return parse_double(text)


def maybe_int(text: Column | str) -> Column:
    return round_half_away(maybe_double(text)).cast("int")


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def int_text(value: Column | str) -> Column:
    return _col(value).cast("string")


def split_match(text: Column | str, separator: str, word: str) -> Column:
    """Whether a delimited text has ``word`` among its parts."""
    return F.array_contains(F.split(_col(text), separator), word)


def ratio(n: Column | str, d: Column | str) -> Column:
    """``n / d``, 0 where the denominator is 0."""
    n, d = _col(n).cast("double"), _col(d).cast("double")
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


# INFO: an ordered array of ``key=value`` and flags.


def info_value(info: Column | str, key: str) -> Column:
    """The first value of a key, or null; a flag has no value."""
    return F.substr(F.get(F.filter(_col(info), lambda item: item.startswith(f"{key}=")), F.lit(0)), F.lit(len(key) + 2))


def _at(info: Column, key: str) -> Column:
    """The place of the first entry of a key, from 1, or 0."""
    return F.array_position(F.transform(info, lambda item: item.startswith(f"{key}=")), True)


def info_set(info: Column | str, key: str, value: Column) -> Column:
    """The first entry of the key replaced, or a new one at the end."""
    info = _col(info)
    at = _at(info, key)
    item = F.concat(F.lit(f"{key}="), value)
    return F.when(at > 0, F.concat(F.slice(info, F.lit(1), (at - 1).cast("int")), F.array(item), F.slice(info, (at + 1).cast("int"), F.size(info)))).otherwise(F.concat(info, F.array(item)))


def info_delete(info: Column | str, key: str) -> Column:
    """INFO without the first entry of the key."""
    info = _col(info)
    at = _at(info, key)
    return F.when(at > 0, _without(info, at)).otherwise(info)


def info_append(info: Column | str, flag: Column | str) -> Column:
    return F.concat(_col(info), F.array(_col(flag)))


def info_prefix_number(info: Column | str, key: str, as_float: bool = True) -> Column:
    """The number of the first ``key=value`` entry whose key begins with ``key``; floats pass through single precision."""
    found = F.filter(_col(info), lambda item: item.startswith(key) & (F.instr(item, "=") > 0))
    text = F.when(F.size(found) > 0, F.regexp_replace(F.get(found, F.lit(0)), "^[^=]*=", ""))
    return parse_double(text).cast("float").cast("double") if as_float else parse_unsigned(text)


# FORMAT and SAMPLE: parallel arrays.


def sample_value(key: str, format: Column | str = "format", sample: Column | str = "sample") -> Column:
    """The sample's value of a FORMAT key, or null."""
    return F.get(_col(sample), (F.array_position(_col(format), key) - 1).cast("int"))


def sample_set(key: str, value: Column, format: Column | str = "format", sample: Column | str = "sample") -> tuple[Column, Column]:
    """FORMAT and SAMPLE with the key's value replaced, or added at the end."""
    format, sample = _col(format), _col(sample)
    at = F.array_position(format, key)
    return (
        F.when(at > 0, format).otherwise(F.concat(format, F.array(F.lit(key)))),
        F.when(at > 0, F.transform(sample, lambda old, k: F.when(k == at - 1, value).otherwise(old))).otherwise(F.concat(sample, F.array(value))),
    )


def _without(items: Column, at: Column) -> Column:
    """An array without its entry at a place from 1."""
    return F.concat(F.slice(items, F.lit(1), (at - 1).cast("int")), F.slice(items, (at + 1).cast("int"), F.size(items)))


def sample_delete(key: str, format: Column | str = "format", sample: Column | str = "sample") -> tuple[Column, Column]:
    format, sample = _col(format), _col(sample)
    at = F.array_position(format, key)
    return F.when(at > 0, _without(format, at)).otherwise(format), F.when(at > 0, _without(sample, at)).otherwise(sample)


def sample_rename(old: str, new: str, format: Column | str = "format") -> Column:
    """FORMAT with the first ``old`` renamed."""
    format = _col(format)
    at = F.array_position(format, old)
    return F.when(at > 0, F.transform(format, lambda key, k: F.when(k == at - 1, F.lit(new)).otherwise(key))).otherwise(format)


def format_prefix_value(key: str, format: Column | str = "format", sample: Column | str = "sample") -> Column:
    """The sample's value of the first FORMAT key that begins with ``key``, or null."""
    at = F.array_position(F.transform(_col(format), lambda item: item.startswith(key)), True)
    return F.get(_col(sample), (at - 1).cast("int"))


def format_prefix_float(key: str, format: Column | str = "format", sample: Column | str = "sample") -> Column:
    """As a number, through single precision; ``.`` and the empty text are missing."""
    return maybe_double(format_prefix_value(key, format, sample)).cast("float").cast("double")


def format_prefix_unsigned(key: str, format: Column | str = "format", sample: Column | str = "sample") -> Column:
    """As an unsigned number; ``.`` counts as missing here, where a single-sample reader would refuse the record."""
    return parse_unsigned(format_prefix_value(key, format, sample))


# Genotypes.

_GT = r"^(?:[0-9]+|\.)(?:[/|](?:[0-9]+|\.))*"


def _alleles(text: Column) -> Column:
    return F.transform(F.split(text, "[/|]"), lambda part: F.when(part == ".", F.lit(-1)).otherwise(part.try_cast("int")))


def parse_gt(gt: Column | str, allow_rest: bool = False) -> Column:
    """Allele numbers of a genotype, -1 for ``.``; an error if it isn't one, and null for null. ``allow_rest`` ends at a foreign character."""
    gt = _col(gt)
    found = F.regexp_extract(gt, _GT, 0)
    rest = F.substr(gt, F.length(found) + 1)
    good = (found != "") & ((~rest.rlike("^[/|.0-9]")) if allow_rest else (rest == ""))
    return F.when(gt.isNull(), F.lit(None).cast("array<int>")).when(good, _alleles(found)).otherwise(F.raise_error(F.concat(F.lit("can't parse genotype: "), gt)))


def try_gt(gt: Column | str) -> Column:
    """As :func:`parse_gt`, with null instead of an error."""
    gt = _col(gt)
    return F.when(gt.rlike(_GT + "$"), _alleles(gt))


# Record predicates.


def is_variant_strict(alt: Column | str = "alt", gt: Column | None = None) -> Column:
    """An alternate allele is there and called: false without a genotype."""
    gt = sample_value("GT") if gt is None else gt
    return F.coalesce((F.size(_col(alt)) > 0) & F.exists(try_gt(gt), lambda a: a > 0), F.lit(False))


def is_variant_record(alt: Column | str = "alt", gt: Column | None = None) -> Column:
    """As :func:`is_variant_strict`, with an error where an alternate allele comes without a readable genotype."""
    gt = sample_value("GT") if gt is None else gt
    some = F.size(_col(alt)) > 0
    return F.when(~some, F.lit(False)).when(gt.isNull(), F.raise_error(F.lit("a record with alternate alleles has no genotype"))).otherwise(F.exists(parse_gt(gt), lambda a: a > 0))


def is_variant(alt: Column | str = "alt") -> Column:
    """Any alternate allele is named."""
    return F.size(_col(alt)) > 0


def is_indel_any_long(ref: Column | str = "ref", alt: Column | str = "alt") -> Column:
    """REF or any ALT is longer than one base: block tools' view, which takes in MNPs and symbolic alleles."""
    return (F.length(_col(ref)) > 1) | F.exists(_col(alt), lambda a: F.length(a) > 1)


def is_indel_site(ref: Column | str = "ref", alt: Column | str = "alt") -> Column:
    """The multi-sample tools' view: an ALT with a dot in it, a REF longer than one base, or any ALT of another length."""
    ref, alt = _col(ref), _col(alt)
    return (F.size(alt) > 0) & ((F.length(ref) > 1) | F.exists(alt, lambda a: (F.instr(a, ".") > 0) | (F.length(a) != F.length(ref))))


def is_indel_range(ref: Column | str = "ref", alt: Column | str = "alt") -> Column:
    """The called-region view: any ALT of another length than REF."""
    ref = _col(ref)
    return F.exists(_col(alt), lambda a: F.length(a) != F.length(ref))


def is_nonvariant_block(ref: Column | str = "ref", alt: Column | str = "alt") -> Column:
    return (F.length(_col(ref)) != 1) & ~is_variant(alt)


# Ranges, 1-based and closed.


def end_value(info: Column | str = "info") -> Column:
    """The number after the first ``END=`` in the INFO text, wherever that stands."""
    return F.regexp_extract(F.array_join(_col(info), ";"), "END=([0-9]+)", 1).try_cast("long")


def record_end(pos: Column | str = "pos", info: Column | str = "info") -> Column:
    return F.coalesce(end_value(info), _col(pos))


def called_range(pos: Column | str = "pos", ref: Column | str = "ref", alt: Column | str = "alt", info: Column | str = "info") -> tuple[Column, Column]:
    """Begin and end of what a record calls: an indel calls the reference bases after its first, none if it only inserts."""
    pos, end = _col(pos), record_end(pos, info)
    indel = (pos == end) & is_indel_range(ref, alt)
    return F.when(indel, pos + 1).otherwise(pos), F.when(indel, end + F.length(_col(ref)) - 1).otherwise(end)


def site_length(pos: Column | str = "pos", ref: Column | str = "ref", info: Column | str = "info") -> Column:
    """Positions of a non-indel locus; 0 for an END before POS or shorter than REF."""
    pos, size = _col(pos), F.length(_col(ref)).cast("long")
    end = info_prefix_number(info, "END", as_float=False)
    return F.when(end.isNull(), size).when((end >= pos) & (size <= end + 1 - pos), end + 1 - pos).otherwise(F.lit(0))


# Filters: an array, PASS as the only entry or none at all.


def filter_add(filters: Column | str, label: Column | str) -> Column:
    """The filters with ``label`` at the end, once; it takes PASS's place."""
    filters = _col(filters)
    label = F.lit(label) if isinstance(label, str) else label
    filters = F.when((F.size(filters) == 1) & (F.get(filters, F.lit(0)) == "PASS"), empty()).otherwise(filters)
    return F.when(F.array_contains(filters, label), filters).otherwise(F.concat(filters, F.array(label)))


def filter_default(filters: Column | str) -> Column:
    """``PASS`` where there is no filter."""
    filters = _col(filters)
    return F.when(F.size(filters) == 0, F.array(F.lit("PASS"))).otherwise(filters)


def is_pass(filters: Column | str = "filter") -> Column:
    """FILTER is exactly ``PASS``."""
    filters = _col(filters)
    return (F.size(filters) == 1) & (F.get(filters, F.lit(0)) == "PASS")


# Derived values of single-sample records.


def gqx(qual: Column | str = "qual", gq: Column | None = None) -> Column:
    """The smaller of the rounded QUAL and GQ, null if either is missing."""
    qual, gq = maybe_int(qual), maybe_int(sample_value("GQ") if gq is None else gq)
    return F.least(qual, gq) + F.lit(0) * (qual + gq)  # least alone skips nulls


# Bases and alleles.


def standardize_reference(seq: Column | str) -> Column:
    """Upper case, IUPAC ambiguity codes and gaps as N, U as T; an error for anything else."""
    found = F.translate(F.upper(_col(seq)), "URYSWKMBDHV.-", "TNNNNNNNNNNNN")
    return F.when(found.rlike("^[ACGTN]*$") | found.isNull(), found).otherwise(F.raise_error(F.concat(F.lit("invalid base in reference: "), F.regexp_extract(found, "[^ACGTN]", 0))))


def standardize_base(base: Column | str) -> Column:
    """A base in upper case, N if it is none of ACGT."""
    base = F.upper(_col(base))
    return F.when(base.isin(*"ACGT"), base).otherwise(F.lit("N"))


def is_valid_base(base: Column | str) -> Column:
    return _col(base).isin(*"ACGTN")


def is_iupac_base(base: Column | str) -> Column:
    return F.upper(_col(base)).isin(*"ACGTURYSWKMBDHVN.-")


def is_valid_sequence(seq: Column | str) -> Column:
    return _col(seq).rlike("^[ACGTN]*$")


def complement(base: Column | str) -> Column:
    """The complementary base; N stays N."""
    return F.translate(_col(base), "ACGT", "TGCA")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def base_to_id(base: Column | str) -> Column:
    """0 to 3 for A, C, G and T, 4 for N; null for others."""
    at = F.array_position(F.array(*map(F.lit, "ACGTN")), _col(base))
    return F.when(at > 0, (at - 1).cast("int"))


def id_to_base(number: Column | str) -> Column:
    return F.get(F.array(*map(F.lit, "ACGTN")), _col(number).cast("int"))


def site_alleles(gt: Column, alt: Column | str, offset: Column, ref_base: Column) -> Column:
    """Bases of a site's alleles at ``offset`` from POS; N where an allele is unknown or not listed."""
    alt = _col(alt)
    return F.transform(gt, lambda a: F.when(a == 0, ref_base).when((a < 0) | (a > F.size(alt)), F.lit("N")).otherwise(F.substr(F.get(alt, a - 1), (offset + 1).cast("int"), F.lit(1))))


def indel_alleles(gt: Column, ref: Column | str, alt: Column | str) -> Column:
    """Allele texts of an indel, X where unknown."""
    ref, alt = _col(ref), _col(alt)
    return F.transform(gt, lambda a: F.when(a == 0, ref).when(a < 0, F.lit("X")).otherwise(F.coalesce(F.get(alt, a - 1), F.lit("X"))))
