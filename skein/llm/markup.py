"""The running text of articles in typesetting markup."""

from __future__ import annotations

import re

_COMMENT = re.compile(r"(?<!\\)%[^\n]*")
_ASIDE = re.compile(r"\\begin\{(comment|thebibliography|equation|align|gather|multline|eqnarray|displaymath|math|figure|table|tabular|verbatim|lstlisting)(\*?)\}.*?(?:\\end\{\1\2\}|\Z)|\\iffalse\b.*?(?:\\fi\b|\Z)", re.S)
_DELIMITER = re.compile(r"\\.|\$\$?|\n[ \t]*\n", re.S)
#: What begins a formula, and what ends it.
_MATH = {"$": "$", "$$": "$$", "\\[": "\\]", "\\(": "\\)"}
_MACRO = re.compile(r"\\(?:re)?(?:new|provide)?command\*?\s*\{?\\([A-Za-z]+)\}?\s*\{([^{}\\]*)\}|\\def\s*\\([A-Za-z]+)\s*\{([^{}\\]*)\}")
_HEADING = re.compile(r"\\(?:title|author|date|part|chapter|(?:sub)*section|(?:sub)?paragraph|begin|end)\*?(?:\[[^\]]{0,300}\]){0,3}(?:\{[^{}]{0,2000}\})?")
_POINTER = re.compile(r"\\(?:[a-z]*cite[a-z]*|[a-z]*ref|label|includegraphics|input|include|bibliographystyle|bibliography|usepackage|documentclass|url)\*?(?:\[[^\]]{0,300}\]){0,3}(?:\{[^{}]{0,2000}\})?")
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?[ \t]?(?:\{\})?|\\.")
_BODY, _END = "\\begin{document}", "\\end{document}"


def _without_math(text: str) -> str:
    """``text`` without formulas, in one pass; one in a line ends with its paragraph, one never closed is text."""
    out, last, begun, at = [], 0, "", 0
    for m in _DELIMITER.finditer(text):
        d = m[0]
        if begun == "$" and d == "$$":
            out.append(text[last:at])
            last = at = m.start() + 1
        elif begun and d == _MATH[begun]:
            out.append(text[last:at])
            last, begun = m.end(), ""
        elif d in _MATH and (not begun or d == begun):
            begun, at = d, m.start()
        elif d[0] == "\n" and begun in ("$", "\\("):
            begun = ""
    return " ".join((*out, text[last:]))


def running_text(text: str) -> str:
    """The paragraphs a reader reads: no preamble, comments, formulas, headings, references or bibliography.

    Macros without parameters are replaced by what they stand for, other commands go and leave
    their argument. A text without ``\\begin{document}`` is all body; an environment that is not
    closed ends with the text.
    """
    text = _COMMENT.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    at = text.find(_BODY)
    macros = {a or b: x or y for a, x, b, y in _MACRO.findall(text if at < 0 else text[:at])}
    body = text if at < 0 else text[at + len(_BODY) :]
    body = body.partition(_END)[0]
    body = _POINTER.sub(" ", _HEADING.sub("\n\n", _without_math(_ASIDE.sub("\n\n", body))))
    return _COMMAND.sub(lambda m: f" {macros.get(m[1], '')} ", body)


_WORD = re.compile(r"[^\W\d_]{2,}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")
_PARAGRAPH = re.compile(r"\n\s*\n")


def sentences(body: str) -> list[list[str]]:
    """The words of each sentence: runs of two letters or more, lower case, a plural s cut off."""
    out = []
    for paragraph in _PARAGRAPH.split(body):
        for sentence in _SENTENCE.split(" ".join(paragraph.split())):
            words = [w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] != "s" else w for w in _WORD.findall(sentence.lower())]
            if words:
                out.append(words)
    return out
