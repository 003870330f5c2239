"""What people read about threats and errors: labels, places and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertext.functions.text import display_name

# What is shown for each layer, error and verdict, and for the units of each kind of file.
LAYERS = {
    "color_threshold": "צבע הטקסט כמעט זהה לרקע - בלתי נראה לעין",
    "micro_font": "גופן זעיר מתחת ל-2 נקודות - בלתי נראה לעין",
    "spatial": "טקסט מוסתר מחוץ לגבולות הדף",
    "z_index": "טקסט קבור מתחת לתמונה",
    "regex_keyword": "הוראה לבינה מלאכותית בטקסט מוסתר",
    "hidden_attr": 'מאפיין "מוסתר" של Word הוחל על הטקסט',
    "white_on_white": "טקסט לבן על רקע לבן - בלתי נראה לעין",
    "tiny_font": "גופן זעיר בלתי נראה",
    "speaker_notes": "ההוראה הוסתרה בהערות הדובר של המצגת",
    "off_slide": "צורה עם טקסט הוסתרה מחוץ לגבולות השקף",
    "zero_width": "תווים בלתי נראים (Unicode) הוטמעו בתוך הטקסט",
}
ERRORS = {
    "ENCRYPTED": "הקובץ מוצפן",
    "CORRUPT": "הקובץ פגום",
    "OVERSIZED": "הקובץ גדול מדי",
    "UNSUPPORTED": "סוג קובץ לא נתמך",
    "TIMEOUT": "הסריקה ארכה זמן רב מדי",
    "IO": "שגיאת קריאת קובץ",
    "INTERNAL": "שגיאת סריקה",
}
OTHER_ERROR, DEFAULT_ERROR = "לא ניתן לסרוק את הקובץ", "INTERNAL"
VERDICTS = {"clean": "נקי", "infected": "נגוע", "unscannable": "לא נסרק", "error": "שגיאה"}
UNITS = {"pdf": ("page", "עמוד"), "docx": ("paragraph", "פסקה"), "pptx": ("slide", "שקף")}
LINE, COLUMN = "שורה", "עמודה"
NOTED = ("CORRUPT", "ENCRYPTED", "OVERSIZED")


def labelled(df: DataFrame, key: str, labels: dict[str, str], name: str, otherwise: Column) -> DataFrame:
    """df with the label of its key as name, or otherwise where the key is null or has none. labels are a few fixed rows."""
    rows = df.sparkSession.createDataFrame(list(labels.items()), "_key string, _label string")
    return df.join(F.broadcast(rows), F.col(key) == F.col("_key"), "left").withColumn(name, F.coalesce("_label", otherwise)).drop("_key", "_label")


def place(location: Column, file_type: Column) -> Column:
    """Where a threat lies, in words, from location (page, paragraph, slide, line, col); each kind of file reads its own fields. Empty where they are null or the kind has none."""
    out = F.lit("")
    for kind, (field, word) in UNITS.items():
        out = F.when(file_type == kind, F.coalesce(F.concat(F.lit(f"{word} "), location[field].cast("string")), F.lit(""))).otherwise(out)
    line = F.concat(F.lit(f"{LINE} "), location["line"].cast("string"))
    return F.when(file_type.isin("txt", "md"), F.coalesce(F.concat(line, F.lit(f", {COLUMN} "), location["col"].cast("string")), line, F.lit(""))).otherwise(out)


def base_name(path: Column) -> Column:
    """The last part of a path with either slash, without invisible code points."""
    return display_name(F.regexp_extract(path, r"[^/\\]*$", 0))


def expandable(verdict: Column, payload: Column) -> Column:
    return F.coalesce(verdict == "infected", F.lit(False)) & payload.isNotNull()


def noted(verdict: Column, code: Column) -> Column:
    """Whether an error is one that people can do something about."""
    return F.coalesce((verdict == "error") & code.isin(*NOTED), F.lit(False))


def clock(ms: Column) -> Column:
    """Day, month and time of milliseconds, in the session's time zone."""
    return F.date_format(F.timestamp_millis(ms), "dd.MM HH:mm")
