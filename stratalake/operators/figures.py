"""What a model says of figures: which of it can be used, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalake.functions.text import blank_to_null

# Names in architecture figures that are no entities; words of the chip domain; how diagrams begin.
NOISE_NAME = r"^(chip|die|bar|reserved|host\s*ddr|gpu|smmu|iommu|iova|local\s*memory|memory\s*\+\s*io|pre-?pci|pci-?domain|in-?house|external\s*atu|inbound|outbound|cross\s*die|tc\d+|550x)|(chip|die|bar|iova|拓扑|封装)"
CHIP_DOMAIN = (
    r"\b(soc|asic|fpga|rtl|ip|ip[-_ ]?xact|register|bitfield|signal|interface|clock|reset|bus|axi|apb|ahb|pcie|pipe|serdes|dma|irq|interrupt|address\s*map|memory\s*map|bar|csr|gpio|spi|i2c|uart|usb|ethernet|"
    r"module|subsystem|controller|clock\s*domain|reset\s*domain)\b|芯片|寄存器|位域|管脚|引脚|信号|接口|总线|时钟|复位|中断|地址映射|模块|子系统"
)
PROTOCOLS = ("axi", "axi4", "axilite", "apb", "ahb", "atb", "pcie", "pipe", "dbi", "dti")


def is_noise(name: Column) -> Column:
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return (n == "") | n.rlike(NOISE_NAME)


def domain(text: Column) -> Column:
    """chip if the text speaks of one, else general."""
    return F.when(F.lower(text).rlike(CHIP_DOMAIN), "chip").otherwise("general")


def interface_name(name: Column, protocol: Column, role: Column) -> Column:
    """An interface's name; one that is only a protocol gets its role, or is null where that says nothing more."""
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    bare = lambda c: F.lower(F.regexp_replace(c, r"[\s_-]+", ""))
    n, p, r = plain(name), plain(protocol), plain(role)
    only = bare(n).isin(*PROTOCOLS)
    return F.when(n == "", None).when(only & (r != ""), F.trim(F.concat(F.coalesce(blank_to_null(p), n), F.lit(" "), r))).when(only & (p != "") & (bare(n) == bare(p)), None).otherwise(n)


def diagram(value: Column, starts: str) -> tuple[Column, Column]:
    """A diagram's text if it begins as it should (starts, a pattern), and whether it is in order; null is in order."""
    text = F.trim(value)
    fits = (text != "") & text.rlike(starts)
    return F.when(fits, text), value.isNull() | fits


def plantuml(value: Column, keywords: str) -> tuple[Column, Column]:
    """A diagram between @startuml and @enduml, or with one of the key words, and whether it is in order."""
    text, low = F.trim(value), F.lower(value)
    fits = (text != "") & ((F.contains(low, F.lit("@startuml")) & F.contains(low, F.lit("@enduml"))) | text.rlike(keywords))
    return F.when(fits, text), value.isNull() | fits


def wavejson(value: Column, keys: tuple[str, ...]) -> tuple[Column, Column]:
    """A JSON object with one of the keys, as text, and whether it is in order."""
    found = F.coalesce(F.arrays_overlap(F.json_object_keys(F.when(F.trim(value).startswith("{"), value)), F.array(*[F.lit(k) for k in keys])), F.lit(False))
    return F.when(found, value), value.isNull() | found
