"""Labels, colours, bounds and defaults that results depend on.

They are stated here once, as plain text, because answers must match them
exactly; everything else in the package takes them as parameters.
"""

# State label -> RGBA, and the colour of any other state.
STATE_COLORS = {
    "เสร็จสิ้น": [0, 148, 50, 180],
    "กำลังดำเนินการ": [252, 186, 3, 200],
    "รอรับเรื่อง": [252, 39, 40, 200],
    "ส่งต่อ": [156, 39, 176, 200],
    "ไม่สามารถแก้ไข": [220, 76, 70, 200],
}
OTHER_STATE_COLOR = [128, 128, 128, 180]
DONE_STATE = "เสร็จสิ้น"

# Labels that stand in for nulls.
UNKNOWN_LABELS = {
    "state": "ไม่ทราบสถานะ",
    "district": "ไม่ระบุเขต",
    "subdistrict": "ไม่ระบุตำบล",
    "organization": "ไม่ระบุหน่วยงาน",
}

# PM2.5 bands: inclusive upper bound in ug/m3, then the band above the last bound.
PM25_BANDS = [
    (25, "Very Good"),
    (37, "Good"),
    (50, "Moderate"),
    (90, "Unhealthy for Sensitive"),
]
PM25_TOP_BAND = "Unhealthy"

# Map centre and date bounds used when nothing can be computed from the data.
DEFAULT_CENTER = (13.7563, 100.5018)  # latitude, longitude
DEFAULT_MIN_DATE = "2021-01-01"
DEFAULT_WINDOW_DAYS = 180

# Province pattern of the air-quality target list.
PROVINCE_PATTERN = "bangkok|กรุงเทพ"

# Text formats.
TICKET_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
TICKET_TIMESTAMP_CHARS = 19
TYPE_STRIP_CHARS = "{} "
LABEL_STRIP_CHARS = "{}"

# Dashboard and chart sizes.
MAX_POINTS = 5000
DASHBOARD_TOP = 10
EXPLORE_TOP = 15
DEFAULT_TYPE_CHOICES = 5
ROLLING_DAYS = 7
RESOLUTION_LIMIT_DAYS = 60
HISTOGRAM_BINS = 30
KDE_POINTS = 200
HEX_RADIUS_M = 200
HEAT_RADIUS_PIXELS = 50
DEFAULT_ZOOM = 11
HEX_ELEVATION_RANGE = (0, 1000)
HEX_ELEVATION_SCALE = 2
WEEKDAYS = [
    "Monday",
    "Tuesday",
    "Wednesday",
    "Thursday",
    "Friday",
    "Saturday",
    "Sunday",
]

# Text model settings.
NGRAM_RANGE = (1, 2)
MIN_DF = 5
MAX_FEATURES = 5000
SPLIT_SEED = 2025
TEST_FRACTION = 0.2
LINEAR_TOLERANCE = 1e-4
BOOSTED_TREES = 100
BOOSTED_DEPTH = 6
BOOSTED_RATE = 0.1

# Columns of the listing and of the map points, in display order.
LISTING_COLUMNS = [
    "ticket_id", "type", "organization", "district", "subdistrict", "state", "timestamp_dt", "comment",
]
MAP_COLUMNS = [
    "longitude", "latitude", "state_color", "ticket_id", "type", "state", "organization", "district", "comment",
]

# CSV quoting that keeps every character, edge blanks and line breaks included.
EXACT_CSV = {
    "header": True,
    "encoding": "UTF-8",
    "quoteAll": True,
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
