"""Options and constants of the layout operators."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Options:
    """Thresholds in pixels or shares; lexicons are empty unless the user gives them."""

    thai: bool = False
    min_confidence: float = 0.30
    line_tolerance: float = 0.6
    nms_overlap: float = 0.60
    table_cover: float = 0.72
    figure_cover: float = 0.80
    large_figure_cover: float = 0.92
    large_figure_share: float = 0.45
    embedded_overlap: float = 0.40
    figures_per_page: int = 2
    tables_per_page: int = 1
    figures_per_document: int = 2
    tables_per_document: int = 2
    smallest_figure_share: float = 0.08
    marker_reach: float = 0.10
    near_rows: int = 12
    near_distance: float = 64.0
    near_height: float = 48.0
    near_overlap: float = 0.12
    chart_label: str = "แผนภูมิ"
    smallest_figure_side: float = 12.0
    smallest_figure_area: float = 900.0
    graphic_pad: float = 6.0
    most_drawings: int = 500
    retention_days: int = 30
    retrain_interval: int = 5
    junk_lines: tuple[str, ...] = field(default_factory=tuple)


# Class names of regions and their numbers in label files.
LABEL_IDS = {
    "title": 0, "plain text": 1, "abandon": 2, "figure": 3, "figure_caption": 4,
    "table": 5, "table_caption": 6, "table_footnote": 7, "isolate_formula": 8, "formula_caption": 9,
}
# Classes by the kind of work they ask for.
FIGURE_CLASSES = ("figure",)
TABLE_CLASSES = ("table",)
TEXT_CLASSES = ("title", "plain text")
# Page sizes, and margins (top, bottom, left, right), in inches.
PAGE_SIZES = {"A4": (8.27, 11.69), "Letter": (8.5, 11.0), "Legal": (8.5, 14.0), "A3": (11.69, 16.54), "B5": (6.93, 9.84)}
MARGINS = {"Normal": (1.0, 1.0, 1.0, 1.0), "Narrow": (0.5, 0.5, 0.5, 0.5), "Moderate": (1.0, 1.0, 0.75, 0.75), "Wide": (1.0, 1.0, 1.5, 1.5)}
# Pixels for a point of the page by quality, and the least for Thai in the fast one (usual, hurried).
SCALES = {"fast": 5.0, "balanced": 7.5, "accurate": 10.0}
THAI_FAST_SCALES = (7.5, 6.0)
# Crumbs of forms and footers, and how the fourth item's body begins.
FOOTER_NOISE = r"แบบฟอร์มเสนอ|จัดทำโดย\s*ศูนย์|e-mail\s*:|ict_its@|หน้า\s*[๐-๙0-9]{1,2}\s*$|ทันทีทันที"
FOOTER_CRUMBS = (r"แบบฟอร์มเสนอ[\s\S]{0,120}", r"จัดทำโดย[\s\S]{0,80}ict_its@[^\s]*", r"หน้า[ \t]*[๐-๙0-9]{1,2}", r"(?:ทันที)+")
ITEM_BODIES = ("จัดทำมาตรฐาน", "ระบบมาตรฐาน", "รับรองและประสาน")
# Names of products that count as healthy Latin text in any case.
PRODUCTS = ("ESET", "MySQL", "MS\\s*SQL", "SQL", "PC", "Plotter", "Firewall", "VMware", "Windows", "Office", "Server", "Multifunction")
# Phrases that a Thai recogniser makes up for blank cells, and for names.
BLANK_CELL_PHRASES = ("ยอมแพ้", "สังคมพิสูจน์", "ทหารบก", "เชื้อพระวงศ์", "จอมพล", "ตาแหนง", "ด้านข้างราชการ", "วรรณจัก", "บล้มเหลว")
NAME_PHRASES = ("นางสาวศาสตราจารย์", "พรรณตำบล", "โสภณเพ็ญ", "วรรทวรร")
