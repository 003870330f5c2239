"""Patterns that mark a text as instructions to a machine reader, and their two engine dialects."""

from __future__ import annotations

import re

# Families of instruction wording. \b and \s are meant as ASCII word edges and Unicode white space.
FAMILIES = {
    "identity": r"\b(AI|LLM|GPT|Claude|ChatGPT|Gemini|Copilot|Bard|language\s+model|artificial\s+intelligence|large\s+language|neural\s+net(?:work)?|machine\s+learning\s+model|assistant|chatbot|bot)\b",
    "override": r"\b(ignore|disregard|forget|override|bypass|overrule|discard|replace|supersede|dismiss|negate)\b",
    "meta": r"\b(instruction|prompt|directive|command|rule|guideline|constraint|previous|prior|original|system|context|training)\b",
    "directive": r"\b(include|mention|say|write|add|output|respond|answer|use|insert|append|repeat|state|tell|produce|generate|provide|give|return|make\s+sure|always|ensure|remember\s+to)\b",
    "target": r"\b(word|phrase|sentence|code|snippet|string|answer|response|explanation|essay|paragraph|solution|submission|reply|output|keyword)\b",
    "conditional": r"(?:if\s+you\s+are|you\s+are\s+an?\s+|when\s+you\s+are|as\s+an?\s*(?:AI|LLM|assistant|model))",
    "jailbreak": r"(?:ignore|disregard|forget)\s+(?:all\s+)?(?:previous|prior)\s+instructions?|do\s+not\s+follow\s+(?:your\s+)?(?:previous|prior|original)\s+instructions?|you\s+are\s+now\s+a\s+different\s+(?:AI|assistant|model)|act\s+as\s+(?:if\s+you\s+are\s+)?a?\s*(?:DAN|jailbreak)|\bDAN\s+mode\b|\bjailbreak\s+mode\b|system\s+prompt\s+override|override\s+(?:the\s+)?system\s+prompt",
    "in_your": r"\b(?:in\s+your\s+|your\s+)(?:answer|response|output|reply|explanation|essay|summary|solution|work|submission)\b",
    "hebrew": r"בינה\s+מלאכותית|מודל\s+שפה|צ'?אט[\s-]*בוט|אם\s+אתה\s+(?:בינה|מודל|עוזר|בוט|מחשב)|כאשר\s+אתה\s+(?:בינה|מודל|עוזר|בוט)|ב(?:תשובה|תגובה|מענה|פלט)\s+שלך|(?:כלול|הוסף|שלב|ציין|כתוב)\s+את\s+ה?מילה",
}

#: What any text that reads as instructions has in it; most texts are told apart by this one search.
GATE = r"\b(?:" + "|".join(FAMILIES[k][3:-3] for k in ("identity", "override", "directive")) + r")\b|" + "|".join(FAMILIES[k] for k in ("conditional", "jailbreak", "in_your", "hebrew"))

# Canonical override phrases in order of precedence, as they are reported.
PHRASES = (
    r"ignore\s+(all\s+)?previous\s+instructions?",
    r"disregard\s+(all\s+)?(previous|prior)\s+instructions?",
    r"do\s+not\s+follow\s+(your\s+)?(previous|prior|original)\s+instructions?",
    r"forget\s+(all\s+)?previous\s+instructions?",
    r"you\s+are\s+now\s+a\s+different\s+(AI|assistant|model)",
    r"act\s+as\s+(if\s+you\s+are\s+)?a?\s*(DAN|jailbreak)",
    r"DAN\s+mode",
    r"jailbreak\s+mode",
    r"system\s+prompt\s+override",
    r"override\s+(the\s+)?system\s+prompt",
)

# The same phrases in letters alone.
COLLAPSED = (
    r"ignore(all)?previousinstructions?",
    r"disregard(all)?(previous|prior)instructions?",
    r"donotfollow(your)?(previous|prior|original)instructions?",
    r"forget(all)?previousinstructions?",
    r"youarenowadifferent(ai|assistant|model)",
    r"actasa?(dan|jailbreak)",
    r"danmode",
    r"jailbreakmode",
    r"systempromptoverride",
    r"override(the)?systemprompt",
)

# Code points that show nothing or turn the reading direction.
INVISIBLE = "​‌﻿‍⁠‎‏⠀‪‫‬‭‮⁦⁧⁨⁩"
# White space and line ends.
SPACES = "\t\n\x0b\x0c\r \xa0                　﻿"
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "


def escaped(chars: str, braces: bool) -> str:
    return "".join(f"\\x{{{ord(c):04X}}}" if braces else f"\\u{ord(c):04X}" for c in chars)


def dialect(pattern: str, spark: bool) -> str:
    """A pattern for Java or RE2: case-folded in ASCII, \\s and \\b spelt out where the engine's own differ."""
    space = escaped(SPACES, not spark)
    out = pattern.replace(r"[\s-]", f"[{space}-]").replace(r"\s", f"[{space}]")
    if spark:  # an edge stands before a word or behind one, so one look to either side decides
        out = re.sub(r"\\b(?=[(A-Za-z])", "(?<![A-Za-z0-9_])", out).replace(r"\b", "(?![A-Za-z0-9_])")
    return f"(?i){out}"
