"""Product attributes from free-text titles, as column expressions in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, labels and patterns that decide the results, in the order in which they apply.
GPU_BRANDS = (("ASUS", "Asus"), ("MSI", "Msi"), ("GIGABYTE", "Gigabyte"), ("ZOTAC", "Zotac"), ("PALIT", "Palit"), ("EVGA", "Evga"), ("PNY", "Pny"), ("SAPPHIRE", "Sapphire"), ("XFX", "Xfx"), ("INNO3D", "Inno3D"), ("GAINWARD", "Gainward"), ("AORUS", "Aorus"))
AMD_MARKS = ("RX", "RADEON", "XT", "XTX")
SYSTEM_WORDS = ("mini pc", "mini-pc", " nuc", "barebones", "desktop pc", "all-in-one", "laptop", "notebook", "gaming pc", "gaming computer", "custom pc", "full pc", "complete pc", "pc bundle", "pc build")
CORE_NAMES = (("dual", 2), ("triple", 3), ("quad", 4), ("hexa", 6), ("octa", 8), ("deca", 10), ("dodeca", 12))
HDD_BRANDS = (("SEAGATE", "Seagate"), ("TOSHIBA", "Toshiba"), ("SAMSUNG", "Samsung"), ("HITACHI", "Hitachi"), ("HGST", "Hgst"), ("FUJITSU", "Fujitsu"), ("MAXTOR", "Maxtor"))
RAM_BRANDS = (("CORSAIR", "Corsair"), ("G.SKILL", "G.Skill"), ("GSKILL", "G.Skill"), ("KINGSTON", "Kingston"), ("SAMSUNG", "Samsung"), ("CRUCIAL", "Crucial"), ("HYPERX", "HyperX"), ("PATRIOT", "Patriot"), ("TEAMGROUP", "TeamGroup"), ("TEAM GROUP", "TeamGroup"), ("ADATA", "ADATA"), ("PNY", "PNY"), ("SK HYNIX", "Hynix"), ("HYNIX", "Hynix"), ("MICRON", "Micron"), ("LEXAR", "Lexar"), ("BALLISTIX", "Ballistix"))
GPU_MODEL = r"(RTX|GTX|TITAN|RX)\s*(\d{2,4})\s*(Ti|SUPER|Ti\s*SUPER|XT|XTX)?"
GPU_MODEL_LONGEST = r"(RTX|GTX|TITAN|RX)\s*(\d{2,4})\s*(Ti\s*SUPER|SUPER|Ti|XTX|XT)?"
VRAM = r"(\d{1,2})\s*GB"
RAM_SIZE, DISK_SIZE = r"\d+\s*gb\s*(ddr\d?|ram)", r"\d+\s*(tb|gb)\s*(ssd|nvme|hdd|m\.2)"
AMD_MODEL = r"Ryzen\s*(?:Threadripper\s*(?:PRO\s*)?)?R?(\d+)\s+(\d+[A-Z0-9]*)"
INTEL_MODEL = r"I([3579])[\s\-](?:CPU\s+)?(\d{3,5}[A-Z0-9]*)"
SOCKET = r"(LGA\s*\d{3,4}|AM\s*[2345]|FM[12]|TR[X]?\d+)"
CORES = r"(\d+)\s*[Cc]ore"
CAPACITY = r"(\d+(?:\.\d+)?)\s*(TB|GB)"
FORM_FACTOR = r"(3\.5|2\.5)"
RPM, RPM_K = r"(\d{4,5})\s*rpm", r"(\d+(?:\.\d+)?)\s*K(?:\s*rpm|\b)"
RAM_TYPE, RAM_KIT, RAM_GB, RAM_SPEED = r"\b(DDR[345])\b", r"(\d+)\s*[X×]\s*(\d+)\s*GB", r"(\d+)\s*GB", r"(\d{3,5})\s*[Mm][Hh][Zz]"


def whole(c: Column) -> Column:
    """The whole part of a number, null if an int can't hold it: titles state sizes of any length."""
    return F.floor(c).try_cast("int")


def found(c: Column, pattern: str, group: int = 1, any_case: bool = True) -> Column:
    return F.nullif(F.regexp_extract(c, f"(?i){pattern}" if any_case else pattern, group), F.lit(""))


def first_of(c: Column, pairs, default: Column | None = None) -> Column:
    """The label of the first pair whose word c contains: a CASE in list order."""
    out = None
    for word, label in pairs:
        test, value = c.contains(word), F.lit(label)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out if default is None else out.otherwise(default)


def any_of(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def gpu_model(t: Column, fix_variants: bool = False) -> Column:
    """Family, number, variant. The first fitting variant counts, so `Ti SUPER` gives TI and `XTX` gives XT, and
    such cards share a product with the plain ones; fix_variants takes the longest one instead."""
    pattern = f"(?i){GPU_MODEL_LONGEST if fix_variants else GPU_MODEL}"
    variant = F.regexp_replace(F.upper(F.regexp_extract(t, pattern, 3)), r"\s+", " ")
    head = F.concat_ws(" ", F.upper(F.regexp_extract(t, pattern, 1)), F.regexp_extract(t, pattern, 2))
    return F.nullif(F.trim(F.concat_ws(" ", head, variant)), F.lit(""))


def gpu_vram(t: Column) -> Column:
    return found(t, VRAM).cast("int")


def gpu_brand(t: Column) -> Column:
    u = F.upper(t)
    return first_of(u, GPU_BRANDS, F.when(any_of(u, AMD_MARKS), "AMD").otherwise("NVIDIA"))


def is_full_system_cpu(t: Column) -> Column:
    low = F.lower(t)
    return any_of(low, SYSTEM_WORDS) | (low.rlike(RAM_SIZE) & low.rlike(DISK_SIZE))


def cpu_brand(t: Column) -> Column:
    return first_of(F.upper(t), (("AMD", "AMD"), ("INTEL", "Intel")), F.lit(""))


def cpu_model(t: Column) -> Column:
    amd = F.concat(F.lit("Ryzen "), found(t, AMD_MODEL, 1), F.lit(" "), F.upper(found(t, AMD_MODEL, 2)))
    intel = F.concat(F.lit("i"), found(t, INTEL_MODEL, 1), F.lit("-"), F.upper(found(t, INTEL_MODEL, 2)))
    return F.coalesce(amd, intel)


def cpu_socket(t: Column) -> Column:
    return F.upper(F.regexp_replace(found(t, SOCKET), r"\s+", ""))


def cpu_cores(t: Column) -> Column:
    return F.coalesce(found(t, CORES, 1, False).try_cast("int"), first_of(F.lower(t), CORE_NAMES))


def hdd_brand(t: Column) -> Column:
    u = F.upper(t)
    wd = u.contains("WESTERN DIGITAL") | u.startswith("WD ") | u.contains(" WD ")
    return F.when(wd, "Western Digital").otherwise(first_of(u, HDD_BRANDS, F.lit("")))


def hdd_capacity_gb(t: Column) -> Column:
    value = found(t, CAPACITY, 1).try_cast("double")
    return whole(F.when(F.upper(found(t, CAPACITY, 2)) == "TB", value * 1000).otherwise(value))


def hdd_interface(t: Column) -> Column:
    return F.when(F.upper(t).contains("SAS"), "SAS").otherwise("SATA")


def hdd_form_factor(t: Column) -> Column:
    return F.concat(F.coalesce(found(t, FORM_FACTOR), F.lit("3.5")), F.lit('"'))


def hdd_rpm(t: Column) -> Column:
    return F.coalesce(found(t, RPM).cast("int"), whole(found(t, RPM_K).try_cast("double") * 1000))


def is_full_system_ram(t: Column) -> Column:
    return any_of(F.lower(t), SYSTEM_WORDS)


def ram_type(t: Column) -> Column:
    return F.upper(found(t, RAM_TYPE))


def ram_capacity_gb(t: Column) -> Column:
    u = F.upper(t)
    kit = found(u, RAM_KIT, 1, False).try_cast("double") * found(u, RAM_KIT, 2, False).try_cast("double")
    most = F.array_max(F.transform(F.regexp_extract_all(u, F.lit(RAM_GB), F.lit(1)), lambda x: x.try_cast("double")))
    size = F.coalesce(kit, most)
    return F.when(size.between(2, 256), size.cast("int"))


def ram_speed(t: Column) -> Column:
    return found(t, RAM_SPEED, 1, False).cast("int")


def ram_brand(t: Column) -> Column:
    return first_of(F.upper(t), RAM_BRANDS)


def attributes(category: Column, t: Column, only: str | None = None) -> dict[str, Column]:
    """One wide row for all categories: attributes of other categories are null; an unknown category has
    an empty brand and model. `dropped` marks listings that the rules leave out. Where all rows are of the one category `only`,
    the conditions are constants, and no other category's patterns are planned."""
    gpu, cpu, hdd, ram = (category == c if only is None else F.lit(c == only) for c in ("GPU", "CPU", "HDD", "RAM"))
    known = gpu | cpu | hdd | ram
    return {
        "brand": F.when(gpu, gpu_brand(t)).when(cpu, cpu_brand(t)).when(hdd, hdd_brand(t)).when(ram, ram_brand(t)).when(~known, ""),
        "model": F.when(gpu, gpu_model(t)).when(cpu, cpu_model(t)).when(~known, ""),
        "vram": F.when(gpu, gpu_vram(t)),
        "socket": F.when(cpu, cpu_socket(t)),
        "cores": F.when(cpu, cpu_cores(t)),
        "capacity_gb": F.when(hdd, hdd_capacity_gb(t)).when(ram, ram_capacity_gb(t)),
        "interface": F.when(hdd, hdd_interface(t)),
        "form_factor": F.when(hdd, hdd_form_factor(t)),
        "rpm": F.when(hdd, hdd_rpm(t)),
        "ram_type": F.when(ram, ram_type(t)),
        "speed": F.when(ram, ram_speed(t)),
        "dropped": F.when(cpu, is_full_system_cpu(t)).when(ram, is_full_system_ram(t) | ram_type(t).isNull() | ram_capacity_gb(t).isNull()).otherwise(False),
    }
