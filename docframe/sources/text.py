"""Text, separated values and Markdown to HTML."""

from __future__ import annotations

import html
import re


def decode(data: bytes) -> str:
    """Without byte order mark, CR and CR LF as LF; a run of invalid bytes is one U+FFFD."""
    text = data.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "surrogateescape")
    return re.sub("[\udc80-\udcff]+", "\ufffd", text).replace("\r\n", "\n").replace("\r", "\n")


def text_to_html(data: bytes) -> str:
    return f'<pre style="white-space: pre-wrap">\n{html.escape(decode(data), quote=False)}</pre>'


def separated(data: bytes, comma: str = ",") -> list[list[str]]:
    """Records of separated values: quotes may stand anywhere, blank lines are left out, short records are padded to the widest."""
    text, rows, row, field, quoted, started, i = decode(data), [], [], [], False, False, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                field.append('"')
                i += 1
            elif c == '"' and text[i + 1 : i + 2] in (comma, "\n", ""):
                quoted = False
            else:
                field.append(c)
        elif c == '"' and not field and not started:
            quoted = started = True
        elif c == comma:
            row.append("".join(field))
            field, started = [], False
        elif c == "\n":
            if row or field or started:
                rows.append([*row, "".join(field)])
            row, field, started = [], [], False
        else:
            field.append(c)
        i += 1
    if row or field or started:
        rows.append([*row, "".join(field)])
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def separated_to_html(data: bytes, comma: str = ",") -> str:
    rows = separated(data, comma)
    if not rows:
        return ""
    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape(c, quote=False)}</{tag}>" for c in cells) + "</tr>"
    return f"<table><thead>{line('th', rows[0])}</thead><tbody>{''.join(line('td', r) for r in rows[1:])}</tbody></table>"


BULLET = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])(?:( +)(.*)|$)")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*([^`]*)$")
RULE = re.compile(r" {0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")
HEADING = re.compile(r" {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$")
DIVIDER = re.compile(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")


def markdown_to_html(source: str) -> str:
    """Headings, rules, quotes, lists with tasks, fenced and indented code, pipe tables, raw HTML, paragraphs."""
    return blocks(source.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n"))


def blocks(lines: list[str], tight: bool = False) -> str:
    out, para, i = [], [], 0

    def flush() -> None:
        if para:
            text = inline("\n".join(x.strip() if not x.endswith("  ") else x.lstrip() for x in para).rstrip())
            out.append(text if tight else f"<p>{text}</p>")
            para.clear()

    while i < len(lines):
        line = lines[i]
        if not line.strip():
            flush()
            i += 1
            continue
        if m := FENCE.match(line):
            flush()
            close, body, i = m[1], [], i + 1
            while i < len(lines) and not re.match(rf" {{0,3}}{close[0]}{{{len(close)},}}\s*$", lines[i]):
                body.append(lines[i])
                i += 1
            out.append(f"<pre><code>{html.escape(chr(10).join(body), quote=False)}\n</code></pre>")
            i += 1
        elif m := HEADING.match(line):
            flush()
            out.append(f"<h{len(m[1])}>{inline(m[2] or '')}</h{len(m[1])}>")
            i += 1
        elif para and re.match(r" {0,3}(=+|-+)\s*$", line):
            level = 1 if "=" in line else 2
            text = inline(" ".join(x.strip() for x in para))
            para.clear()
            out.append(f"<h{level}>{text}</h{level}>")
            i += 1
        elif RULE.match(line):
            flush()
            out.append("<hr>")
            i += 1
        elif re.match(r" {0,3}>", line):
            flush()
            body = []
            while i < len(lines) and lines[i].strip():
                body.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
                i += 1
            out.append(f"<blockquote>{blocks(body)}</blockquote>")
        elif (m := BULLET.match(line)) and (not para or m[2] in "-*+" or m[2][:-1] == "1") and (m[4] or not para):
            flush()
            text, i = list_at(lines, i)
            out.append(text)
        elif line.startswith("    ") and not para:
            body = []
            while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip()):
                body.append(lines[i][4:])
                i += 1
            out.append(f"<pre><code>{html.escape(chr(10).join(body).rstrip(), quote=False)}\n</code></pre>")
        elif "|" in line and i + 1 < len(lines) and DIVIDER.match(lines[i + 1]) and len(cells(line)) == len(cells(lines[i + 1])):
            flush()
            marks = ["center" if c.startswith(":") and c.endswith(":") else "right" if c.endswith(":") else "left" if c.startswith(":") else "" for c in cells(lines[i + 1])]
            row = lambda tag, own: "<tr>" + "".join(f"<{tag}{f' align={a!r}' if a else ''}>{inline(c)}</{tag}>" for c, a in zip(own + [""] * len(marks), marks)) + "</tr>"
            head, body, i = row("th", cells(line)), [], i + 2
            while i < len(lines) and lines[i].strip() and not re.match(r" {0,3}>", lines[i]):
                body.append(row("td", cells(lines[i])))
                i += 1
            out.append(f"<table><thead>{head}</thead><tbody>{''.join(body)}</tbody></table>")
        elif not para and re.match(r" {0,3}<(?:!--|/?[A-Za-z])", line):
            body = []
            while i < len(lines) and lines[i].strip():
                body.append(lines[i])
                i += 1
            out.append("\n".join(body))
        else:
            para.append(line)
            i += 1
    flush()
    return "\n".join(out)


def cells(line: str) -> list[str]:
    inner = re.sub(r"^\s*\||(?<!\\)\|\s*$", "", line.strip())
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", inner)]


def list_at(lines: list[str], i: int) -> tuple[str, int]:
    first = BULLET.match(lines[i])
    ordered, kind, items, loose = first[2][-1] in ".)" and first[2][0].isdigit(), first[2][-1], [], False
    while i < len(lines):
        m = BULLET.match(lines[i])
        if m is None or m[2][-1] != kind or RULE.match(lines[i]):
            break
        gap = len(m[3] or " ")
        indent = len(m[1]) + len(m[2]) + (gap if gap <= 4 else 1)
        body, i = [(" " * (gap - 1) if gap > 4 else "") + (m[4] or "")], i + 1
        while i < len(lines):
            if not lines[i].strip():
                follows = next((x for x in lines[i:] if x.strip()), "")
                if not follows.startswith(" " * indent) and BULLET.match(follows) is None:
                    break
                loose = loose or follows.startswith(" " * indent) or BULLET.match(follows) is not None
                body.append("")
            elif lines[i].startswith(" " * indent):
                body.append(lines[i][indent:])
            elif BULLET.match(lines[i]) or not body[-1] or RULE.match(lines[i]) or HEADING.match(lines[i]) or FENCE.match(lines[i]):
                break
            else:
                body.append(lines[i].strip())
            i += 1
        items.append(body)
    out = []
    for body in items:
        box = re.match(r"\[([ xX])\] ", body[0])
        if box:
            body[0] = body[0][4:]
        mark = f'<input type="checkbox"{"" if box[1] == " " else " checked"}> ' if box else ""
        out.append(f"<li>{mark}{blocks(body, tight=not loose)}</li>")
    tag, start = ("ol", f' start="{int(first[2][:-1])}"' if first[2][:-1] != "1" else "") if ordered else ("ul", "")
    return f"<{tag}{start}>{''.join(out)}</{tag}>", i


def inline(text: str) -> str:
    """Code, links, images, emphasis, strike, autolinks, breaks; raw tags and character references pass."""
    held: list[str] = []

    def hold(s: str) -> str:
        held.append(s)
        return f"\x00{len(held) - 1}\x00"

    text = re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: hold(f"<code>{html.escape(m[2].strip() if m[2].strip() else m[2], quote=False)}</code>"), text, flags=re.S)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: hold(html.escape(m[1])), text)
    text = re.sub(r"<((?:https?|ftp|mailto):[^\s<>]*)>", lambda m: hold(f'<a href="{html.escape(m[1])}">{html.escape(m[1])}</a>'), text)
    text = re.sub(r"</?[A-Za-z][^<>]*>|<!--.*?-->", lambda m: hold(m[0]), text, flags=re.S)
    text = re.sub(r"&(?!#?\w+;)", "&amp;", text).replace("<", "&lt;").replace(">", "&gt;")
    target = r"\(\s*<?([^\s()<>]*(?:\([^\s()]*\)[^\s()]*)*)>?(?:\s+[\"'(].*?[\"')])?\s*\)"
    text = re.sub(r"!\[([^\]]*)\]" + target, lambda m: hold(f'<img src="{m[2]}" alt="{m[1]}">'), text)
    text = re.sub(r"\[((?:[^\[\]]|\[[^\]]*\])*)\]" + target, lambda m: hold(f'<a href="{m[2]}">') + m[1] + hold("</a>"), text)
    text = re.sub(r"(?<![\w/\"=])(https?://[^\s<\x00]*[^\s<\x00.,;:!?)\"'])", lambda m: hold(f'<a href="{m[1]}">{m[1]}</a>'), text)
    for mark, tag in ((r"\*\*", "strong"), (r"(?<!\w)__", "strong"), (r"\*", "em"), (r"(?<!\w)_", "em"), ("~~", "del")):
        end = mark.replace(r"(?<!\w)", "") + (r"(?!\w)" if "_" in mark else "")
        text = re.sub(rf"{mark}(?=\S)(.+?)(?<=\S){end}", rf"<{tag}>\1</{tag}>", text, flags=re.S)
    text = re.sub(r" {2,}\n|\\\n", "<br>\n", text)
    while "\x00" in text:
        text = re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], text)
    return text
