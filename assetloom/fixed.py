"""Thresholds, word lists and name tables that results depend on.

These must hold exactly these values for results to be right; they are stated
plainly and kept together so that nothing else in the package repeats them.
"""

# --- content features -------------------------------------------------------
UNIQUE_COLOR_CAP = 4096
EDGE_THRESHOLD = 48
FLAT_THRESHOLD = 4
GRAY_CHROMA_MAX = 12
SAT_LOW_CHROMA_MAX = 32
EDGE_SAMPLE_CAP = 4_000_000
LUMA_WEIGHTS = (77, 150, 29)  # red, green, blue; sum 256

# --- classification ---------------------------------------------------------
ICON_MAX_EDGE = 128
ICON_ASPECT_MAX = 2.0
PALETTE_COLORS = 256
FLAT_GRAPHIC_RATIO = 0.60
GRAPHIC_EDGE_MAX = 0.08
DOC_BIMODALITY = 0.55
DOC_GRAY_RATIO = 0.85
DOC_ENTROPY_MAX = 4.5
UI_FLAT_RATIO = 0.35
UI_ASPECT_MIN = 1.3
PHOTO_ENTROPY_STRONG = 4.0
BUCKET_OF_CLASS = {
    "photograph": "lossy",
    "graphic-logo": "lossless-flat",
    "icon": "lossless-flat",
    "document": "lossless-flat",
    "ui-screenshot": "mixed-safe",
}

# --- decision ---------------------------------------------------------------
FORMAT_SWITCH_THRESHOLD = 0.05
MAX_SHORTLIST = 3
FAST_LOSSY_QUALITY = 85
CONVERT_AVIF_QUALITY = 80
RESPONSIVE_QUALITY = 80
QUALITY_TARGETS = {"visually-lossless": 90.0, "high": 70.0, "medium": 50.0}
SEARCH_MIN, SEARCH_MAX, SEARCH_ITERS = 1, 100, 8

# --- limits -----------------------------------------------------------------
MAX_IMAGE_DIMENSION = 65_535
MAX_IMAGE_PIXELS = 64 * 1024 * 1024
RESIZE_MAX_EDGE = 50_000
RESIZE_MAX_AREA = 134_217_728
CACHE_ENTRY_MAX_BYTES = 256 * 1024 * 1024
MANIFEST_VERSION, MANIFEST_MAX_TARGETS = 1, 1024
RECIPE_VERSION, RECIPE_MAX_STEPS = "1", 1024
SVG_SNIFF_WINDOW = 1024

# --- colour transfer --------------------------------------------------------
SRGB_DECODE_CUT = 0.040448237
SRGB_ENCODE_CUT = 0.0031308

# --- extensions and formats -------------------------------------------------
RASTER_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "ico", "avif", "svg"]
RAW_EXTENSIONS = ["nef", "nrw", "cr2", "cr3", "arw", "srf", "sr2", "dng", "raf", "rw2", "orf",
                  "pef", "srw", "rwl", "raw"]
HEIF_EXTENSIONS = ["heic", "heif"]
IMAGE_EXTENSIONS = RASTER_EXTENSIONS + RAW_EXTENSIONS + HEIF_EXTENSIONS
FORMAT_OF_EXT = {
    "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif", "bmp": "bmp", "tif": "tiff",
    "tiff": "tiff", "ico": "ico", "webp": "webp", "avif": "avif",
}
EXT_OF_FORMAT = {
    "png": "png", "jpeg": "jpg", "gif": "gif", "bmp": "bmp", "tiff": "tiff", "ico": "ico",
    "webp": "webp", "avif": "avif",
}
MIME_OF_FORMAT = {
    "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "avif": "image/avif",
    "gif": "image/gif", "bmp": "image/bmp", "tiff": "image/tiff", "ico": "image/ico",
}
EIGHT_BIT_ONLY = ["jpeg", "avif", "webp", "bmp"]
COLOR_TYPES = ["l8", "la8", "rgb8", "rgba8", "l16", "la16", "rgb16", "rgba16", "rgb32f", "rgba32f"]
AVIF_BRANDS = ["avif", "avis"]
HEIC_BRANDS = ["heic", "heix", "heim", "heis", "hevc", "hevx"]
LIVE_CONTAINERS = ["svg", "heic", "raw"]  # containers whose pixel format is a stand-in

# --- metadata ---------------------------------------------------------------
JPEG_MANIFEST_KIND = "APP11"
PNG_MANIFEST_KIND = "caBX"
JPEG_STRIPPED_KINDS = [f"APP{n}" for n in range(1, 16)] + ["COM"]
PNG_STRIPPED_KINDS = ["eXIf", "iCCP", "tEXt", "zTXt", "iTXt", "tIME", "caBX"]
TAG_IMAGE_DESCRIPTION, TAG_MAKE, TAG_MODEL, TAG_ORIENTATION = 0x010E, 0x010F, 0x0110, 0x0112
TAG_ARTIST, TAG_COPYRIGHT, TAG_DATETIME_ORIGINAL = 0x013B, 0x8298, 0x9003
TAG_BODY_SERIAL, TAG_LENS_MAKE, TAG_LENS_MODEL = 0xA431, 0xA433, 0xA434
CAMERA_TAGS = [TAG_MAKE, TAG_MODEL, TAG_BODY_SERIAL, TAG_LENS_MODEL, TAG_LENS_MAKE,
               TAG_DATETIME_ORIGINAL]
KEPT_TAGS = [TAG_ORIENTATION, TAG_COPYRIGHT, TAG_ARTIST]

# --- lint -------------------------------------------------------------------
ICC_BULKY_BYTES = 4096
SAVINGS_MIN_BYTES, SAVINGS_MIN_PERCENT = 4096, 10
SEVERITY_RANK = {"error": 0, "warn": 1, "info": 2}
SARIF_LEVEL = {"error": "error", "warn": "warning", "info": "note"}

# --- recipes ----------------------------------------------------------------
TERMINAL_STEP = "optimize"
BUNDLED_MAX_EDGE = {"web": 2048, "gallery": 2560, "product": 1600}
EDIT_OP_RANK = {"auto-orient": 0, "resize": 1, "invert": 2}

# --- benchmark summaries ----------------------------------------------------
ISO_TARGET_SCORE = 82.0
MP_BUCKETS = [("small", 0.0, 2.0), ("medium", 2.0, 12.0), ("large", 12.0, 1e9)]
ASPECT_TOLERANCE = 0.01
EDGE_TOLERANCE = 1
PINNING_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "ico", "webp", "avif"]
