"""Generated phrases that the residue models are fitted on, in four languages, and the forms of slots."""

from __future__ import annotations

import itertools


def _fill(templates: list[str], **words: list[str]) -> list[str]:
    """Every template with every combination of the words it names."""
    out = []
    for t in templates:
        names = [n for n in words if f"{{{n}}}" in t]
        for combo in itertools.product(*(words[n] for n in names)):
            s = t
            for n, w in zip(names, combo, strict=True):
                s = s.replace(f"{{{n}}}", w)
            out.append(s)
    return out


THINGS = ["map", "graph", "console", "page", "evidence panel", "theme list", "sphere", "app", "site", "chart", "report"]
FIELDS = ["title", "description", "caption", "summary", "finding", "area name", "body text", "author", "name", "text", "paragraph", "note", "heading"]

# Words of the usual placeholder Latin, and the stems and endings from which made-up Latin is built.
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum arcu tempus magnis nostra viscera vivamus fermentum quam ludus partis orbita amenti perni ipsa dolum sedum vidare".split()
STEMS = "lor dol fer lud quat con al sed vid orb part mag nostr visc pern ament sitr temp vel arc utl ips".split()
ENDINGS = "em um a is are it ita us or ore el at in am".split()
MASH = "asdf qwer jkl qwerty zxcv foo bar baz abc xyz test lorem hjkl aaa bbb".split()


def _latin() -> list[str]:
    made = [s + e for s in STEMS for e in ENDINGS]
    words = LATIN * 5 + made
    out = []
    for k in range(700):
        n = 5 + k % 8
        pick = [words[(k * 7919 + j * j * 104_729 + j * 31) % len(words)] for j in range(n)]
        out.append(" ".join(pick).capitalize() + ".")
    return out


def _mash() -> list[str]:
    return [" ".join(MASH[(k * 31 + j * j * 17 + j * 5) % len(MASH)] for j in range(3 + k % 8)) for k in range(160)] + ["test test 123 test", "test 1 2 3", "test test test", "asdf asdf asdf asdf", "blah blah blah"] * 3


def filler() -> list[str]:
    t = [
        "Your {f} goes here.", "Insert a short {f} here.", "Insert a short {f} in this field...", "Insert some {f} before release", "Enter some {f} in this field", "Enter a {f} here",
        "Put your {f} in this field...", "Add a short {f} about the dataset in this box.", "Write the {f} here", "TODO write the {f} of this theme", "TODO: add {f}", "{F} not written yet", "{F} TBA", "{F} TBD",
        "{F} to follow", "{F} coming soon", "({f} missing, draft 6)", "({f} pending)", "[{f} to be added]", "Replace me with the real {f}.", "Replace this {f} before publishing.", "Type your {f} here", "This is where the {f} will go.",
        "Placeholder {f}", "Sample {f} for layout only", "Dummy {f}, please replace", "Placeholder copy for the {f}.", "Sample {f}, to be replaced before this card is published.", "Sub{f}", "{F} text",
    ]
    low = _fill([x for x in t if "{F}" not in x], f=FIELDS)
    up = _fill([x for x in t if "{F}" in x], F=[f.capitalize() for f in FIELDS])
    fixed = [
        "Lorem ipsum placeholder copy for the sidebar.", "(content pending)", "Content coming soon.", "No content yet.", "This text is a placeholder.", "More text to come.", "Text goes here.", "Under construction.", "Heading 1", "Heading 2", "Subheading", "Body copy.", "Body text.", "Footer text",
        "Hier steht später der Beschreibungstext.", "Hier kommt der Text hin.", "Hier den Titel einfügen.", "Platzhaltertext, bitte ersetzen.", "Beschreibung folgt.", "Text folgt in Kürze.", "Inhalt noch nicht vorhanden.", "Dies ist ein Blindtext.",
        "Aquí va el texto de la ficha.", "Aquí va el título.", "Inserte aquí la descripción.", "Texto de relleno, sustituir.", "Descripción pendiente.", "Contenido próximamente.", "Escriba aquí el resumen.",
        "Тут буде опис набору даних.", "Тут буде текст.", "Вставте сюди заголовок.", "Текст-заповнювач, замініть його.", "Опис буде пізніше.", "Вміст ще не готовий.", "Введіть тут короткий опис.",
    ] * 4
    return low + up + fixed + _latin() + _mash()


STATUS = {
    400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 408: "Request Timeout", 410: "Gone", 413: "Payload Too Large", 429: "Too Many Requests",
    500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}
SAYS = [
    "Service temporarily unavailable", "The page you asked for isn't here.", "The page you requested could not be found.", "Upstream took too long to answer.", "The upstream gave no valid answer.", "Access denied by the gateway", "Access denied",
    "You have no permission to view this dataset.", "You do not have permission to access this resource.", "Your session has expired. Sign in again to go on.", "Not authenticated", "Authentication required", "Something went wrong on our side.", "Something went wrong. Please try again later.",
    "Unhandled exception while rendering", "An unexpected error occurred.", "no such route: /map/cells", "No route matches the request", "You are sending requests too fast, slow down.", "Rate limit exceeded, retry later", "The request timed out.", "Connection refused", "Connection reset by peer", "The server encountered an internal error", "Page not found",
    "Seite nicht gefunden", "Dienst nicht verfügbar", "Zugriff verweigert", "Interner Serverfehler", "Zeitüberschreitung der Anfrage", "Ein Fehler ist aufgetreten. Bitte versuchen Sie es später erneut.",
    "Página no encontrada", "Servicio no disponible", "Acceso denegado", "Error interno del servidor", "Tiempo de espera agotado", "Se ha producido un error. Inténtelo de nuevo más tarde.",
    "Сторінку не знайдено", "Сервіс недоступний", "Доступ заборонено", "Внутрішня помилка сервера", "Час очікування вичерпано", "Сталася помилка. Спробуйте пізніше.",
]


def errors() -> list[str]:
    codes = [str(c) for c in STATUS]
    names = list(STATUS.values())
    pairs = [f"{c} {n}" for c, n in STATUS.items()]
    said = SAYS + names
    out = [f"HTTP/1.1 {p}\nContent-Length: 0\nRetry-After: 146" for p in pairs] * 2 + [f"HTTP/1.1 {p}\nContent-Type: text/html" for p in pairs]
    out += [f"Error {c}\n{n}" for c, n in STATUS.items()] * 2 + pairs * 2 + said * 3
    out += [f"Oops! {s}" for s in said] + [f"{s} (reference 9f29ddccca, 20:29)" for s in said] + [f"Error: {s}" for s in said]
    for c, s in itertools.product(codes[::3], said[::2]):
        out += [f"<html><head><title>{c} {s}</title></head>\n<body><center><h1>{c} {s}</h1></center><hr></body></html>", f'{{"detail": "{s}", "status": {c}, "request": "4ab721b5"}}', f"Error {c}\n{s}"]
    out += [f"<Error><Code>{k}</Code><Message>{s}</Message><RequestId>B46266731B52F7</RequestId></Error>" for k, s in itertools.product(["NoSuchKey", "AccessDenied", "SlowDown", "InternalError"], said[::2])]
    out += _fill(["We're sorry, the {t} could not answer.", "Sorry, the {t} is not available right now.", "The {t} is down for maintenance, come back shortly.", "The {t} is temporarily unavailable.", "The {t} failed to load.", "Could not load the {t}."], t=[*THINGS, "evidence service", "server"])
    out += ["upstream connect error or reset before headers; status 429", "upstream request timeout; status 504", "Contact the desk if this goes on.", "Contact support if the problem persists.", "Try again in 5 minutes.", "Try again later.", "Please try again.", "Contact the administrator if this persists."] * 6
    trace = 'Traceback (most recent call last):\n  File "/srv/app/{m}.py", line 139, in {m}\n    return {m}[key]\n{e}'
    out += [trace.replace("{m}", m).replace("{e}", e) for m, e in itertools.product(["render", "fill", "text", "main", "views"], ["KeyError: 'period'", "TypeError: 'region'", "TimeoutError: 'theme'", "ValueError: bad value", "ConnectionError: refused"])]
    return out


def scripts() -> list[str]:
    on = ["enable", "allow", "switch on", "activate", "turn on"]
    js = ["JavaScript", "JS", "scripts", "client-side scripts", "scripting"]
    where = ["in your browser", "for this site", "and reload the page"]
    out = _fill(["To {v} the {t}, {o} {j} {w}."], v=["see", "use", "browse", "open", "load"], t=THINGS[:8], o=on, j=js, w=where)[::3]
    out += _fill(["Please {o} {j} to see the {t}.", "Please {o} {j} to continue.", "{j} must be on to see the {t}.", "{j} must be allowed to use the {t}.", "You need to {o} {j} to run this app.", "{O} {j} and reload.", "Please change this to see the {t}.", "Please change this to draw the {t}.", "Change your settings to see the {t}."], o=on, O=[x.capitalize() for x in on], j=js, t=THINGS[:8])[::2]
    out += _fill(["It looks like {j} {b} {s}."], j=js, b=["is", "was"], s=["turned off", "off", "blocked", "disabled"]) * 2
    out += _fill(["Sorry, we can't {v} the {t} while your browser blocks {j}.", "We can't {v} the {t} without {j}.", "This page can't {v} the {t} while your browser blocks {j}.", "This page can't {v} the {t} without {j}."], v=["see", "open", "load", "use", "show"], t=THINGS[:8], j=js)[::3]
    out += ["Your browser does not run scripts, so the graph can't be drawn.", "This console needs scripts. Enable them in your browser and reload.", "Checking that you are not a robot… this page reloads by itself once scripts run.", "Loading… (requires JavaScript)", "JavaScript is disabled in your browser.", "This site requires JavaScript.", "Please enable cookies and JavaScript."] * 8
    out += ["Bitte aktivieren Sie JavaScript, um fortzufahren.", "JavaScript ist in Ihrem Browser deaktiviert.", "Schalten Sie JavaScript ein, um die Karte zu sehen.", "Diese Seite benötigt JavaScript.", "Active JavaScript para ver el mapa.", "Su navegador no ejecuta JavaScript.", "Habilite JavaScript para continuar.", "Esta página necesita JavaScript.", "Увімкніть JavaScript, щоб побачити карту.", "JavaScript вимкнено у вашому браузері.", "Для роботи сторінки потрібен JavaScript.", "Дозвольте скрипти та оновіть сторінку."] * 8
    return out + [f'<div class="note">{x}</div>' for x in out[:: max(1, len(out) // 150)]]


def discussion() -> list[str]:
    """Sentences that talk about errors, scripts, templates or placeholders as their subject."""
    t = [
        "Requests answered with {c} rose to {n} a day after the depot moved its pages.", "Error rate per route: {c} for the northern ring, {n} for the southern one.", "We talked about error pages: a body with {c} used to be stored as a note, which is now refused.",
        "The scripts were split in two; JavaScript errors on the map fell by half.", "The {n} busiest cells were not found in the southern box.", "Placeholders in old cards are gone since the last clean-up; please report any you see.",
        "In the template guide, the braces mark the slot for a place and the brackets one for a theme.", "The word undefined in the export column stands for refunds that the clerk left open.", "Access to the depot was denied on two days, which explains the gap in the series.",
        "The share of {c} answers fell in week {n}.", "The team wrote the map in JavaScript and loads it with the page.", "Drivers tried again at the next stop in {n} cases.", "The error of the median is below {n} minutes.", "The service was unavailable to the fleet for {n} hours, and the counts show it.",
        "Die Fehlerquote je Route fiel auf {n}.", "Die Seite {n} des Berichts nennt den Grund.", "La tasa de error por ruta bajó a {n}.", "La página {n} del informe da la razón.", "Частка помилок на маршрут впала до {n}.", "Сторінка {n} звіту називає причину.",
        "Set the flag in the logging format to get the time of each stage.", "The phrase table writes the metric and the renderer puts the name in when the answer is built.", "The text of the summary was rewritten in week {n}.", "A short description of the dataset is in the card.", "Refused for low support: {n} rows.", 
        "The column row_count holds the rows of a cell, read by get_rows, and max_rows_per_cell caps it.", "snake_case_name camelCaseName kebab-case some_long_name", "The metric (avg_wait_min) of {n} rows; see user_id.", "_inner_ and **outer** words, and _both of them_ here.",
        "if (x > {n}) { return 'up'; } else { stop(); }", "for (const a of rows){ total += a; } return total", 'The payload {"metric": "rating", "z": 2.4, "rows": {n}}. It was sent.', '{"name": "x", "n": {n}}', "a[i] = b[j]; f(x[1], y)",
        "### Finding P-{n}", "## Notes # of rows: {n}", "--- === >>> !!! ??? ~~~ ### ***", "---===>>>!!!???", "What?! No... Really??? Yes!!! See (a) and (b)?", "| col | rows |\n|-|-|\n| a | {n} |", "Level <c7> holds more rows than <c6>, see [P4] and [P{n}].", "<b>bold</b> and <i>thin</i>",
    ]
    boxes = ["- [x] confirm the ring size", "- [ ] check the layer", "* [x] done", "The sets {A, B} and {A, C} share one cell.", "with x in {a, b, c} or {d}.", "In the guide, '[[ ]]' and '<>' mark the place.", "<a|b> and <|end|>"]
    t += boxes * 2
    return _fill(t, c=["404", "500", "502", "503"], n=["12", "318", "47", "5"])


NAMES = ["name", "area", "metric", "place", "region_label", "anchor.title", "row_count", "n", "value", "period", "user.first_name", "date", "first name", "your title"]
_BRACKETS = [("{", "}"), ("[", "]"), ("<", ">")]
_SIGNS = "%$@#~?!^|_:"
_MIXED = [("${", "}"), ("#{", "}"), ("%(", ")s"), ("{%", "%}"), ("<%=", "%>"), ("<%", "%>"), ("&lt;", "&gt;"), ("[TBD: ", "]"), ("[INSERT ", " HERE]"), ("[your ", " here]"), ("<insert ", ">"), ("[to do: ", "]")]


def wraps() -> list[tuple[str, str]]:
    """What stands before and after a slot's name: brackets once to three times, signs, and mixed forms, tight or spaced."""
    tight = [(a * n, b * n) for a, b in _BRACKETS for n in (1, 2, 3)] + [(x * n, x * n) for x in _SIGNS for n in (1, 2, 3) if not (n == 1 and x in "#~?!^_@")] + _MIXED
    return tight + [(f"{a} ", f" {b}") for a, b in tight if len(a) > 1 and not a.endswith(" ")]


CONTEXTS = ["the ~ of", "~ of", "In ~, and", "for ~; the", "Title: ~", "~: the", "«~» at", "the 12 ~ of", "the ~ 12 of", "~/~", "at ~ (and"]


def slots(wrap: list[tuple[str, str]] | None = None) -> list[str]:
    """Slots as they stand in sentences and lines; ``wrap``: only these forms."""
    out = []
    for a, b in wraps() if wrap is None else wrap:
        for name in [*NAMES, *(n.upper() for n in NAMES if " " not in n)]:
            out += [t.replace("~", a + name + b) for t in CONTEXTS]
    return out


def bare() -> list[str]:
    """Words and signs that stand where a value was left out."""
    return [t.replace("~", x) for x in ["undefined", "XXXX", "________", "%s", "%d", "{0}", "{1}", "[object Object]"] for t in CONTEXTS]


# Names that look like slots but are environment variables, attributes of log records.
NOT_SLOTS = {"HOME", "PATH", "USER", "PWD", "TMPDIR", "SHELL", "LANG"}
LOGGED = {"asctime", "created", "filename", "funcName", "levelname", "levelno", "lineno", "message", "module", "msecs", "name", "pathname", "process", "processName", "relativeCreated", "thread", "threadName", "taskName"}
