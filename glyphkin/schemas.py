"""Tables of the analysis as Spark schemas (DDL). Explicit everywhere; nothing is inferred."""

from __future__ import annotations

IMAGE_H, IMAGE_W = 40, 32
IMAGE_SIZE = IMAGE_H * IMAGE_W

BOX = "struct<t: int, b: int, l: int, r: int>"
CHAR_IN_WORD = f"struct<tblr: array<int>, polygon: array<int>, labels: map<string, double>>"
WORDS_JSON = f"tblr array<int>, polygon array<int>, text string, text_score double, word_bbox_score double, chars array<{CHAR_IN_WORD}>"

METADATA = "`Index` int, Printer string, FileName string, Remarks string"
CATALOGUE = "Signature string"
# Column names and order of the resolution table.
DPI_COLUMNS = ("suelta", "page", "DPI (width)", "DPI (height)", "width (in)", "height (in)", "width (cm)", "height (cm)", "Source of physical dimension")
DPI = ", ".join(f"`{c}` {'string' if c in ('suelta', 'page', DPI_COLUMNS[-1]) else 'double'}" for c in DPI_COLUMNS)
CHAR_DICT = "char string, id int"

WORD = f"doc string, page string, word_idx int, tblr {BOX}, polygon array<int>, text string, text_score double, word_bbox_score double, chars array<{CHAR_IN_WORD}>"
FFT_WINDOW = "doc string, page string, x int, y int, angle float"
WORD_ANGLES = "doc string, page string, word_idx int, page_angle float, stroke float"
CHAR = "doc string, page string, word_idx int, char_idx int, img array<float>, label string"
CHAR_ITALIC = "doc string, page string, word_idx int, char_idx int, is_italic boolean"
DOC_ITALIC = "doc string, threshold double, n_valid_strokes long"
CLUSTER = "doc string, cluster_id long, mean array<double>, label string, share double, n long, italic double"
DISTANCE = "style string, letter string, doc_a string, doc_b string, dist double"
PAIR_SCORE = "style string, doc_a string, doc_b string, n int, n1hat int, weight double"
