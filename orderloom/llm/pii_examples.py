"""Labelled lines for the tagger, drawn from a seed: invented persons of many countries in many kinds of lines.

A line is a list of pieces, each a text and its type or None, so the spans are known without any rule that finds them.
Lines are put together from independent choices (labels, separators, quotes, records, sentences) rather than from whole
sentences; sentences and code around and between them are lines of Python's own standard library and its documentation.
"""

import importlib.util
import random
import re
import string
import unicodedata
from functools import lru_cache

TYPES = ("email", "phone", "national_id", "street", "name")

# Common given names of many countries.
GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Karen Daniel "
    "Emily Matthew Olivia George Charlotte Oliver Amelia Harry Isla Liam Emma Noah Ava Ethan Mia Grace Nathan Hannah Dylan Megan Sean Siobhan "
    "Carlos María José Carmen Juan Lucía Miguel Isabel Antonio Pilar João Ana Pedro Beatriz Rafael Inês Tiago Luiz Camila Diego Valentina Mateo "
    "Giulia Matteo Chiara Alessandro Francesca Lorenzo Giovanni Paola Pierre Camille Jean Amélie Louis Chloé François Élodie Thierry Nathalie Jürgen "
    "Heike Klaus Ursula Stefan Sabine Wolfgang Birgit Lars Ingrid Björn Astrid Søren Mette Henrik Kirsten Mikko Aino Jari Piotr Agnieszka Krzysztof "
    "Małgorzata Jan Jana Petr Zuzana Ivan Olga Dmitri Natalia Sergei Svetlana Andrei Ioana Bogdan Elena Dragan Milica Goran Ivana Georgios Eleni Nikos "
    "Katerina Mehmet Ayşe Mustafa Fatma Emre Zeynep Mohammed Fatima Ahmed Aisha Omar Layla Hassan Noor Yusuf Mariam Reza Shirin Rajesh Priya Amit "
    "Sunita Vikram Anjali Arjun Deepa Wei Fang Jun Xiu Hiroshi Yoko Kenji Sakura Takashi Naoko Minho Jiwoo Thanh Linh Kwame Ama Chidi Ngozi Thabo"
).split()
# Common family names of many countries, some of them ordinary words.
FAMILY = (
    "Smith Johnson Brown Taylor Wilson Davies Evans Walker White Roberts Green Hall Wood Jackson Clarke Hill Baker King Wright Turner Young Allen "
    "Scott Parker Cook Bell Lane West North Fox Stone Rivers Marsh Bishop Price Banks Page Long Short Day Winter Summers Field Ford Brooks Cross "
    "O'Brien O'Connor McDonald McCarthy MacLeod Murphy Kelly Walsh García Rodríguez González Fernández López Martínez Sánchez Pérez Silva Santos "
    "Oliveira Souza Pereira Costa Almeida Ferreira Rossi Russo Ferrari Esposito Bianchi Romano Colombo D'Angelo Martin Bernard Dubois Durand Moreau "
    "Lefèvre Lambert Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schäfer Hoffmann Hansen Olsen Larsen Nielsen Jensen Andersson Johansson "
    "Lindqvist Virtanen Korhonen Nowak Kowalski Wiśniewska Zieliński Novák Svoboda Dvořáková Horvat Kovačević Ivanov Petrova Kuznetsov Popescu Ionescu "
    "Papadopoulos Nikolaidis Yılmaz Kaya Demir Khan Hussain Rahman Al-Farsi El-Sayed Haddad Hosseini Patel Sharma Singh Gupta Kumar Reddy Iyer Wang "
    "Zhang Chen Nguyen Tran Pham Kim Park Choi Sato Suzuki Tanaka Watanabe Okafor Mensah Dlamini Abebe Diallo de_Vries Jansen Bakker Visser Cohen Levi"
).replace("de_Vries", "Devries").split()
# Sounds and endings that family names are invented from.
ONSETS = "b br c ch cl cr d dr f fr g gl gr h j k kl kr l m n p pr qu r s sch sh sk sl sp st sv t th tr v w wh y z".split()
VOWELS = "a e i o u ae ai ea ei io ou ü ö á é".split()
CODAS = "b ck d l ll ld m mm n nd ng nk nt p r rd rk rl rn rs rt s ss st t th x z".split()
ENDINGS = (
    "son sen sson ski ska cki wicz ov ova ev eva in ina enko uk ek ová ić ović escu eanu ez es inho elli etti ini one ano eau ard et ier oux mann berg feld bach stein er ert auer "
    "hof ton ley ford ham wood well worth man smith by more stad dal gren lund qvist nen la opoulos akis idis yan ian oglu zade moto mura saki ura wala kar nath"
).split()
PARTICLES = ("van der", "van", "von", "de la", "de", "del", "della", "di", "da", "dos", "le", "van den", "zu", "al", "af", "ter", "bin", "el", "y")
# What organisations, sites and products are called by.
ORGANISATION = (
    "Inc Inc. Ltd Limited LLC GmbH AG SA S.p.A. BV Corporation Corp. Company Systems Solutions Software Technologies Labs Laboratory Group Holdings Partners Foundation Institute "
    "University College School Bank Capital Media Networks Energy Consulting Associates Industries Services Society Association Council Project Contributors Team Authors Committee Tools "
    "Works Studio Data Cloud Health Motors Airlines Press Trust Union"
).split()
SITES = "Airport Station Bridge Valley Harbour Island County Beach Lake River Mountain Forest Stadium Tower Castle Port Bay Falls Junction Depot Campus District Province Terms Site Test".split()
PRODUCTS = "Server Client Engine Manager Studio Framework Edition Suite Desktop Mobile Router Firewall Kernel Compiler Protocol Library Toolkit Service Player Editor Viewer Format License Licence Agreement Standard".split()
TOWN_ENDS = "ville town burg bury ford ham chester mouth port field stadt hausen dorf ów grad hagen vik holm ano one ac".split()
ROLE = (
    "info support admin sales contact help hello noreply no-reply security abuse postmaster webmaster hostmaster billing press jobs hr legal dev devs team ci build bot builds release releases "
    "ops alerts monitoring git root daemon cron mailer newsletter notifications service office accounts privacy compliance helpdesk feedback bugs maintainers list mail deploy robot jenkins"
).split()
TOP = "com org net io de fr it es co.uk nl se pl eu edu gov info dev com.br co.jp ch at be ca com.au in example test invalid".split()
# Labels of fields by type, of several languages and spellings.
LABELS = {
    "name": "name|Name|full_name|fullName|author|Author|@author|Authors|owner|Owner|maintainer|Maintainer|contact|Contact|customer|customer_name|patient|employee|holder|user|assignee|reviewer|Reviewed-by|"
    "Signed-off-by|Reported-by|Tested-by|Acked-by|approved by|Approved by|written by|Written by|created by|signed|Signature|recipient|To|From|Cc|attn|Attn.|Dear|manager|Nombre|Nome|Nom|Vorname, Name|"
    "Autor|auteur|autore|Ansprechpartner|responsable|imię i nazwisko|nome completo|display_name|billing_name|beneficiary|witness|tenant|editor|translator|speaker",
    "email": "email|Email|E-Mail|e-mail|mail|mailto|email_address|contact|Contact|Reply-To|From|To|Cc|author_email|maintainer_email|user_email|login|username|write to|correo|courriel|sent to|recipient|posta elettronica",
    "phone": "phone|Phone|tel|Tel.|tel.|telephone|mobile|Mobile|cell|phone_number|phoneNumber|fax|Fax|call|hotline|contact|mob.|Telefon|téléphone|teléfono|telefono|Handy|whatsapp|pager|home_phone|on-call|desk",
    "national_id": "ssn|SSN|national_id|nationalId|tax_id|taxId|TIN|tax number|NI number|nino|fiscal code|codice fiscale|CF|DNI|NIF|NIE|CPF|PESEL|BSN|personnummer|PAN|Aadhaar|passport|id_number|ID no.|id|identity|"
    "Steuer-ID|Steuernummer|numéro de sécurité sociale|NIR|CURP|RRN|AHV-Nr.|SIN|TFN|insurance_no|national insurance|social security|social_security_number|document|holder_id|citizen_id|personal no.|TC kimlik",
    "street": "address|Address|addr|street|Street|street_address|address_line1|line1|home_address|billing_address|shipping_address|residence|lives at|Adresse|Anschrift|indirizzo|dirección|domicilio|endereço|adres|location|deliver to|ship to|office|HQ|visit",
}
LABELS = {k: v.split("|") for k, v in LABELS.items()}
OTHER_LABELS = "status id level role city town country zip currency amount total count date created_at version type kind state group team region price qty notes comment active score lang plan balance dept ref".split()
TITLES = "Dr. Dr Mr. Mr Mrs. Mrs Ms. Ms Prof. Professor Herr Frau Sr. Sra. Dott. Mme M. Sir Capt. Engineer Doctor".split()
BEFORE_PERSON = "by from to with for of and ask see per thanks_to via cc contact ping call told met emailed asked as said like after tell reach contact_our reported_by suggested_by fixed_by courtesy_of credit_to hi hello dear".split()
AFTER_PERSON = "said wrote thinks asked is was has will found reported fixed added suggested wants called owns signed lives left joined and or who to for on about (retired) about_this".split()
LEADS = ("", "", "", "", "// ", "# ", "## ", "-- ", "/* ", " * ", "<!-- ", "    # ", "\t// ", ";; ", "- ", "* ", "> ", "% ", "  ", "\t", "\t\t", '"""', "REM ", "#: ", "1. ", "    ", "        ", "|| ", "'' ")
TRAILS = ("", "", "", "", "", " */", " -->", ";", ".", ",", '"""', " |", ")", "  ", " //", "\\n", "</p>", "...", "!", "?", " #")
MODULES = "argparse ast calendar cgitb codecs collections configparser csv ctypes datetime decimal difflib doctest email.message fractions ftplib gettext http.client http.server imaplib inspect json locale logging mailbox optparse pathlib pdb pickle platform pydoc_data.topics random sched shutil smtplib socket sqlite3 ssl statistics string subprocess tarfile tempfile textwrap threading tkinter trace typing unittest.mock urllib.request uuid webbrowser xml.dom.minidom zipfile".split()

# Words of further languages, from which remarks are put together.
PROSE = tuple(
    x.split()
    for x in (
        "der die das und ist nicht wird nur bei mit für über unter nach vor zwischen wenn sonst alle jede keine Liste Wert Zeile Datei Fehler Aufruf Ergebnis Zahl Schlüssel Prüfung Tabelle Anfang Ende Länge Zeit muss kann darf steht läuft fehlt prüfen löschen lesen schreiben neue alte gültig ungültig später früher überall höchstens",
        "le la les des du et est pas ne que qui pour avec sans dans sur sous après avant chaque toutes aucune liste valeur ligne fichier erreur appel résultat nombre clé contrôle tableau début fin durée doit peut reste manque vérifier supprimer lire écrire nouvelle ancienne dernière première déjà à où très même clés données réponse entrée",
        "el la los las un una y es no que por para con sin en sobre bajo después antes cada todas ninguna lista valor línea archivo fallo llamada resultado número clave prueba tabla inicio fin duración debe puede queda falta comprobar borrar leer escribir nueva vieja última primera año también según está más datos respuesta entrada",
        "il lo la gli le un una e è non che per con senza in su sotto dopo prima ogni tutte nessuna lista valore riga errore chiamata risultato numero chiave prova tabella inizio fine durata deve può resta manca controllare cancellare leggere scrivere nuova vecchia ultima già perché più così dati risposta ingresso quando sempre soltanto",
        "o a os as um uma e é não que por para com sem em sobre depois antes cada todas nenhuma lista valor linha arquivo erro chamada resultado número chave teste tabela início fim duração deve pode fica falta verificar apagar ler escrever nova velha última já até também são mais dados resposta entrada quando sempre apenas",
        "de het een en is niet dat voor met zonder in op onder na tussen elke alle geen lijst waarde regel bestand fout oproep resultaat aantal sleutel toets tabel begin einde duur moet kan blijft ontbreekt nakijken wissen lezen schrijven nieuwe oude laatste eerste ook als dan wordt worden gegevens antwoord",
    )
)

Pieces = list[tuple[str, str | None]]
_PERSONAL = re.compile(r"@\w+\.|\b(?:author|copyright|thanks|contributed|written|by [A-Z]|Python|Guido)\b|\d{6}", re.I)


@lru_cache(maxsize=1)
def library_lines() -> list[str]:
    """Lines of the standard library that are not about persons; none where its sources are not at hand."""
    out = []
    for name in MODULES:
        try:
            found = importlib.util.find_spec(name)
            with open(found.origin, encoding="utf-8") as f:
                lines = f.read().replace("\\n'", "\n").splitlines()
        except (ImportError, OSError, AttributeError, TypeError):
            continue
        out += [x.strip(" '\"") for x in lines if 8 <= len(x.strip()) <= 160 and not _PERSONAL.search(x)]
    return out or ["the value is kept until the next call", "return value if value is not None else default"]


def plain(s: str) -> str:
    """A name as it is written in addresses."""
    s = s.lower().translate(str.maketrans({"ł": "l", "ø": "o", "ß": "ss", "ı": "i", "'": None, " ": None}))
    return "".join(c for c in unicodedata.normalize("NFKD", s) if c.isascii() and (c.isalpha() or c == "-"))


class Maker:
    def __init__(self, seed: int, parts: list[tuple[str, str]]):
        self.r = random.Random(seed)
        self.listed = {k: [p for p, x in parts if x == k] for k in ("given", "family")}
        self.lines = library_lines()
        words = {w for x in self.lines for w in re.findall(r"(?<![\w.])[a-z]{3,12}(?![\w(.])", x)}
        self.vocabulary = sorted(words)

    # Small parts

    def digits(self, n: int) -> str:
        return "".join(self.r.choice(string.digits) for _ in range(n))

    def capitals(self, n: int) -> str:
        return "".join(self.r.choice(string.ascii_uppercase) for _ in range(n))

    def hexa(self, n: int) -> str:
        s = "".join(self.r.choice("0123456789abcdef") for _ in range(n))
        return s.upper() if self.r.random() < 0.2 else s

    def shaped(self, pattern: str) -> str:
        """9 stands for a digit, A for a capital, a for a small letter; the rest stands for itself."""
        r = self.r
        f = {"9": string.digits, "A": string.ascii_uppercase, "a": string.ascii_lowercase}
        return "".join(r.choice(f[c]) if c in f else c for c in pattern)

    def pick(self, *options):
        return self.r.choice(options)

    def word(self) -> str:
        return self.r.choice(self.vocabulary)

    def words(self, a: int, b: int) -> str:
        """So many consecutive words of a library line, or single words."""
        n = self.r.randint(a, b)
        x = self.r.random()
        if x < 0.25:
            language = self.r.choice(PROSE)
            return " ".join(self.r.choice(language) for _ in range(n))
        if x < 0.55:
            return " ".join(self.word() for _ in range(n))
        w = self.r.choice(self.lines).split()
        at = self.r.randrange(max(1, len(w) - n + 1))
        return " ".join(w[at : at + n])

    def field_word(self) -> str:
        r = self.r
        if r.random() < 0.3:
            return r.choice(OTHER_LABELS)
        return self.pick(self.word(), f"{self.word()}_{self.word()}", self.word() + self.word().title(), self.word().upper())

    # Persons

    def invented(self) -> str:
        r = self.r
        s = r.choice(ONSETS) + r.choice(VOWELS[: 5 if r.random() < 0.85 else None])
        if r.random() < 0.75:
            s += r.choice(CODAS)
        if r.random() < 0.35:
            s += r.choice(ONSETS) + r.choice(VOWELS[:5])
        if r.random() < 0.75:
            s += r.choice(ENDINGS)
        elif r.random() < 0.7:
            s += r.choice(VOWELS[:5]) + r.choice("n r s l t o a".split())
        return s[:14].capitalize() if len(s) > 3 else s.capitalize() + "er"

    def given(self) -> str:
        r = self.r
        x = r.random()
        if x < 0.3 and self.listed["given"]:
            return r.choice(self.listed["given"])
        return r.choice(GIVEN) if x < 0.88 else self.invented()

    def surname(self) -> str:
        r = self.r

        def one() -> str:
            x = r.random()
            if x < 0.15 and self.listed["family"]:
                return r.choice(self.listed["family"])
            if x < 0.33:
                return r.choice(FAMILY)
            if x < 0.36:
                return self.word().title()
            s = self.invented()
            return r.choice(["Mc", "O'", "Mac", "Al-", "D'", "De"]) + s if x > 0.96 else s

        return f"{one()}-{one()}" if r.random() < 0.07 else one()

    def written(self, g: str, f: str) -> str:
        """A name in one of the ways in which names are written."""
        r, i, x = self.r, self.r.choice(string.ascii_uppercase), self.r.random()
        if x < 0.40:
            return f"{g} {f}"
        if x < 0.54:
            return f"{f}, {g}"
        if x < 0.60:
            return f"{g} {i}. {f}"
        if x < 0.67:
            return f"{g[0]}. {f}"
        if x < 0.70:
            return self.pick(f"{g[0]}. {i}. {f}", f"{g[0]}.{i}. {f}", f"{f}, {g[0]}.", f"{f}, {g} {i}.", f"{g[0]} {f}", f"{f} {g[0]}.")
        if x < 0.76:
            return f"{f} {g}"
        if x < 0.80:
            return f"{g} {self.given()} {f}"
        if x < 0.83:
            return f"{g} {f} {self.surname()}"
        if x < 0.88:
            return f"{g} {r.choice(PARTICLES)} {f}"
        if x < 0.90:
            return self.pick(f"{g}-{self.given()} {f}", f"{r.choice(PARTICLES)} {f}, {g}", f"{g} {i} {f}")
        if x < 0.95:
            return f"{g} {f}".upper()
        if x < 0.97:
            return self.pick(f"{f.upper()}, {g}", f"{g} {f.upper()}", f"{f.upper()} {g}", f"{f}, {g}".upper(), f"{g} {i}. {f}".upper())
        return f"{g} {f}".lower() if f in FAMILY or f in self.listed["family"] else f"{g} {f}"

    def domain(self) -> list[str]:
        r = self.r
        host = self.pick(plain(self.invented()), self.word(), self.word() + self.word(), self.word() + "-" + self.word(), plain(self.surname()) or "host", self.shaped("aaaaa"), self.word() + self.digits(1))
        w = [host, *r.choice(TOP).split(".")]
        return [self.pick("mail", "eu", "cs", "corp", "students", self.word(), self.shaped("aa")), *w] if r.random() < 0.3 else w

    def email(self, g: str, f: str, local: str = "") -> str:
        r, g, f = self.r, plain(g) or "anna", plain(f) or "vale"
        local = local or self.pick(
            f"{g}.{f}", f"{g}.{f}", f"{g}_{f}", f"{g}-{f}", f"{f}.{g}", f"{g[0]}{f}", f"{g[0]}.{f}", f"{g}{f}", f"{f}{g[0]}", f"{g}{self.digits(2)}", f"{g}.{f}{self.digits(2)}", f"{f}{self.digits(3)}",
            f"{g}.{f}+{self.word()}", f"{g}", f"{g}.{g[0]}.{f}", f"{g}_{f}{self.digits(2)}",
        )
        x, y = r.random(), r.random()
        if x < 0.06:
            local = local.title()
        d = self.domain()
        if y < 0.78:
            s = local + "@" + ".".join(d)
            return s.upper() if x > 0.97 else s
        at, dot = self.pick(
            (" [at] ", " [dot] "), ("[at]", "[dot]"), ("[at]", "."), (" (at) ", " (dot) "), ("(at)", "."), ("(at)", "(dot)"), (" at ", " dot "), (" at ", " dot "), (" AT ", " DOT "), (" [at] ", "."),
            ("{at}", "{dot}"), ("<at>", "<dot>"), (" (at) ", "."), ("_at_", "_dot_"), (" [AT] ", " [DOT] "), (" @ ", "."),
        )
        return local + at + dot.join(d)

    def phone(self) -> str:
        r, s = self.r, self.shaped
        x = r.random()
        if x < 0.15:  # any country code, digits in any groups
            sep = self.pick(" ", "-", ".", "", " ", "/")
            return f"+{r.randint(1, 999)}" + self.pick(" ", " ", "-", "") + sep.join(self.digits(n) for n in self.pick((3, 3, 3), (2, 3, 4), (2, 2, 2, 2), (3, 4), (4, 4), (1, 2, 2, 2, 2), (3, 3, 4), (5, 5), (9,), (10,), (2, 7), (4, 3, 3)))
        if x < 0.25:
            return self.pick("0", "(0)", "") .join([""]) + self.pick("(0", "(") + self.digits(r.randint(1, 4)) + ")" + self.pick(" ", "") + self.pick(" ", "-", "").join(self.digits(n) for n in self.pick((3, 4), (4, 4), (3, 3), (6,), (7,), (2, 2, 2), (4, 3)))
        return s(self.pick(
            "(999) 999-9999", "999-999-9999", "999.999.9999", "999.999.9999", "999.999.9999", "999-999-9999", "+1 999-999-9999", "+1 (999) 999-9999", "+19999999999", "1-999-999-9999", "1 999 999 9999", "999 999 9999", "+1-999-999-9999", "+1.999.999.9999",
            "+44 9999 999999", "+44 (0)9999 999999", "+44 (0)99 9999 9999", "09999 999999", "099 9999 9999", "0999 999 9999", "09999 999 999", "+44 99 9999 9999", "09999999999", "+449999999999",
            "+33 9 99 99 99 99", "09 99 99 99 99", "09.99.99.99.99", "0999/9999999", "099/99999999", "0999/999999", "0999/999 99 99", "+33 (0)9 99 99 99 99", "+49 99 9999999", "+49 999 99999 999", "099/9999999", "0999-9999999", "0999 9999999", "+49 (0)99 999999", "+49 99 99999 99",
            "+39 099 9999 9999", "+39 999 999 9999", "099-9999999", "+34 999 99 99 99", "999 99 99 99", "+34 999 999 999", "699 999 999", "+31 9 99999999", "099-9999999", "+46 99-999 99 99", "099-999 99 99",
            "+47 99 99 99 99", "+48 999 999 999", "+420 999 999 999", "+7 999 999-99-99", "8 (999) 999-99-99", "+90 999 999 99 99", "+91 99999 99999", "+91-9999999999", "+86 999 9999 9999", "+81 9-9999-9999",
            "099-9999-9999", "+82 99-9999-9999", "+55 99 99999-9999", "(99) 9999-9999", "(99) 99999-9999", "+61 9 9999 9999", "(09) 9999 9999", "+61 999 999 999", "+27 99 999 9999", "+353 99 999 9999", "+41 99 999 99 99",
        )).replace("(00", "(01")

    def national_id(self, labelled: bool = False) -> str:
        """Digits alone, or in groups of three, say nothing by themselves: they are drawn only for labelled places."""
        while True:
            v = self.any_national_id()
            if labelled or not re.fullmatch(r"\d+|\d{1,3}(?:[ -]\d{3}){2,3}|\d{4} \d{4} \d{4}", v):
                return v

    def any_national_id(self) -> str:
        r, s = self.r, self.shaped
        month, day, year = f"{r.randint(1, 12):02d}", f"{r.randint(1, 28):02d}", self.digits(2)
        fiscal = "".join(r.choice("BCDFGLMNPRSTVZAEIOU") for _ in range(6)) + year + r.choice("ABCDEHLMPRST") + day + s("A999A")
        x = self.pick(
            s("999-99-9999"), s("999-99-9999"), s("999-99-9999"), s("999 99 9999"), s("AA999999A"), s("AA 99 99 99 A"), s("AA999999A"), s("AA 99 99 99 A"), s("AA 999999 A"), fiscal, fiscal, fiscal, fiscal.lower(), fiscal.lower(),
            s("99999999A"), s("99999999-A"), s("99.999.999-A"), "XYZ"[r.randrange(3)] + s("9999999A"), "XYZ"[r.randrange(3)] + s("-9999999-A"), s("999.999.999-99"), s("99999999999"), year + month + day + s("-9999"),
            "19" + year + month + day + s("-9999"), r.choice("12") + f" {year} {month} " + s("99 999 999 99"), r.choice("12") + year + month + s("99999999"), r.choice("12") + f" {year} {month} " + s("99 999 999"),
            s("99 999 999 999"), s("AAAAA9999A"), s("9999 9999 9999"), day + month + year + s("-999A"), day + month + year + s(" 99999"), day + month + year + s("-9999"), year + "." + month + "." + day + s("-999.99"),
            s("756.9999.9999.99"), s("999 999 999"), s("999-999-999"), s("99999999A"), "".join(r.choice("BCDFGMNPRS") for _ in range(4)) + year + month + day + r.choice("HM") + s("AAAAA99"),
            s("999999") + "19" + year + month + day + s("999") + self.pick("X", "9"), year + month + day + s("-9999999"), s("9999999AA"), s("9999999A"), s("99-99999999-9"), s("99.999.999-9"), year + month + day + s("9999999"),
            s("A99999999"), s("AA9999999"), s("A9999999A"), s("999/999/9999"), year + month + day + s("/9999"), s("99999999999A"), s("9 999 999 999"),
        )
        return x

    def street(self) -> str:
        r = self.r
        n = str(r.randint(1, 250)) if r.random() < 0.85 else str(r.randint(250, 9999))
        if r.random() < 0.15:
            n += self.pick("a", "b", "B", "c", "-" + str(r.randint(1, 99)), " bis", "/" + str(r.randint(1, 20)))
        p = self.pick(self.invented(), self.invented(), self.surname(), r.choice(FAMILY), self.word().title(), self.invented() + " " + self.word().title(), self.pick("North ", "South ", "East ", "West ", "Old ", "New ", "Upper ", "St. ") + self.invented(), r.choice("Oak Maple High Church Station Park Main Mill Victoria London Bridge School Elm Cedar Lake King's Queen's Washington".split()))
        flat = ""
        if r.random() < 0.25:
            flat = self.pick(", ", " ", ", ") + self.pick("Apt ", "Apt. ", "Unit ", "Flat ", "Suite ", "Apartment ", "#", "Ste ", "Floor ", "Room ") + self.pick(str(r.randint(1, 400)), str(r.randint(1, 30)) + self.capitals(1), self.capitals(1))
        way = r.choice("Street Street Street St St. Road Road Rd Rd. Lane Lane Ln Ln. Avenue Avenue Ave Ave. Court Ct Ct. Drive Dr Dr. Boulevard Blvd Blvd. Square Place Terrace Way Close Crescent Highway Parkway Grove Gardens Mews Row Walk Rise Hill Circle Trail".split())
        if r.random() < 0.5:
            s = f"{n}{self.pick(' ', ' ', ' ', ', ')}{p} {way}{flat}"
            return s.upper() if r.random() < 0.03 else s
        comma = self.pick(" ", " ", ", ")
        return self.pick(
            f"{n}{comma}rue {self.pick('', '', 'de ', 'du ', 'de la ')}{p}", f"{n} avenue {p}", f"{n}{self.pick(' ', ', ')}{self.pick('boulevard', 'place', 'chemin de', 'allée', 'impasse', 'quai')} {p}",
            f"{self.pick('Via', 'Via', 'Viale', 'Piazza', 'Corso', 'Largo')} {self.pick('', '', 'della ', 'del ', 'dei ')}{p}{comma}{n}", f"{self.pick('Calle', 'Calle', 'Avenida', 'Paseo', 'Plaza', 'C/')} {self.pick('', '', 'de ', 'de la ')}{p}{comma}{n}",
            f"{self.pick('Rua', 'Avenida', 'Travessa', 'Praça', 'Rua')} {self.pick('', 'das ', 'da ', 'do ')}{p}{comma}{n}", f"{p.split()[0]}{self.pick('straße', 'straße', 'strasse', 'str.', 'weg', 'platz', 'allee', 'gasse', 'ring')} {n}",
            f"{self.pick('Am', 'An der', 'Im', 'Unter den')} {p} {n}", f"{p.split()[0]}{self.pick('gatan', 'vägen', 'gracht', 'straat', 'laan', 'vej', 'gade', 'veien', 'katu', 'tie', 'kade', 'plein')} {n}", f"{self.pick('ul.', 'ulica', 'al.', 'os.', 'Strada', 'Ulitsa', 'Odos')} {p} {n}",
            f"{p} {self.pick('Caddesi', 'Sokak', 'utca', 'út', 'ulice', 'Marg', 'Nagar')} {self.pick('No: ', '', '')}{n}", f"{p} {way} {n}", f"{self.pick('calle', 'via', 'rua')} {p.lower()} {n}",
        )

    def entity(self, kind: str, who: tuple[str, str], labelled: bool = False) -> tuple[str, str]:
        if kind == "national_id":
            return self.national_id(labelled), kind
        if kind == "name":
            return self.written(*who), kind
        if kind == "email":
            return self.email(*who), kind
        return getattr(self, kind)(), kind

    # What is no personal data

    def date(self) -> str:
        r = self.r
        y, m, d = f"{self.pick('19', '20', '20')}{self.digits(2)}", f"{r.randint(1, 12):02d}", f"{r.randint(1, 31):02d}"
        return self.pick(f"{y}-{m}-{d}", f"{y}-{m}-{d}", f"{y}-{m}-{d}", f"{d}/{m}/{y}", f"{d}.{m}.{y}", f"{y}{m}{d}", f"{y}/{m}/{d}", f"{y}-{m}-{d} {r.randint(0, 23):02d}:{self.digits(2)}")

    def number(self) -> str:
        r, s, d = self.r, self.shaped, self.digits
        x = r.random()
        if x < 0.22:
            return d(r.randint(5, 13))
        if x < 0.32:
            return self.date()
        if x < 0.38:
            return f"{self.hexa(8)}-{self.hexa(4)}-{self.hexa(4)}-{self.hexa(4)}-{self.hexa(12)}"
        if x < 0.44:
            return s("".join(r.choice("aA9") for _ in range(r.randint(12, 60))))
        return self.pick(
            d(r.randint(1, 20)), d(r.randint(7, 12)), f"{d(2)}.{d(1)}.{d(r.randint(1, 4))}", f"10.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}", f"{self.pick('192.168', '172.16', '127.0')}.{r.randint(0, 255)}.{r.randint(0, 255)}", f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}", f"20{d(2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
            f"20{d(2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}{self.pick('T', ' ')}{r.randint(0, 23):02d}:{d(2)}:{d(2)}", f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/20{d(2)}", f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.20{d(2)}",
            self.hexa(r.choice([6, 7, 8, 12, 16, 32, 40])), "0x" + self.hexa(r.choice([2, 4, 8, 16])), f"{self.hexa(8)}-{self.hexa(4)}-{self.hexa(4)}-{self.hexa(4)}-{self.hexa(12)}", s("AA99 9999 9999 9999 9999 99"), s("AA99AAAA99999999999999"),
            s("9999 9999 9999 9999"), s("9999-9999-9999-9999"), s("9999-9999-9999"), s("AA9999999999"), s("999-9-99-999999-9"), s("978-9-999-99999-9"), s("-9.9999999"), s("99.999999, -99.999999"), s("$9,999.99"), s("9,999,999"), s("9 999 999"),
            s("1999-2999"), f"20{d(2)}-20{d(2)}", s("A99-9999"), s("AAA-9999"), s("AA-999-99-99999"), s("AA-9999-99"), s("999x999"), s("9.99e-99"), s("99%"), s("v9.99.9"), "1" + d(9), "1" + d(12), "1" + d(18), "16" + d(8), "17" + d(17), s("99:99:99"), s("10.99999/aaaa.9999"),
            s("AAA999999999AA"), s("999999-9"), s("99999-9999"), s("AA99 9AA"), s("99999"), s("RFC 9999"), s("ISO 9999-9"), s("CVE-9999-99999"), s("#9999"), s("99-9999-99"), f"{d(3)}.{d(3)}.{d(3)},{d(2)}", s("AAAA9999AA9999999"),
            f"{d(8)} {d(8)}", f"{d(4)}, {d(4)}, {d(4)}", f"[{d(3)}, {d(3)}, {d(3)}, {d(3)}]", f"{d(3)} {d(3)} {d(3)} {d(3)} {d(3)}",
        )

    def counted(self) -> str:
        """A number with what it counts or names, so that its shape alone doesn't decide."""
        label = self.pick("part", "part no.", "order", "order no.", "invoice", "seq", "serial", "S/N", "sku", "build", "rev", "batch", "ticket", "issue", "version", "release", "port", "epoch", "offset", "sha1", "digest", "token", "key", "account", "IBAN", "ISBN", "card", "iccid", "isin", "cusip", "instrument", "lot", "tracking", "row", "line", "page", "room", "flight", "barcode", "EAN", "timestamp", "at", "since", "from", "window", "range", "size", "total", "sum of", self.field_word(), self.field_word())
        like = self.pick(self.number(), self.number(), self.number(), self.capitals(2) + "-" + self.national_id(), self.number() + "-" + self.digits(2), self.pick("#", "v", "r", "x") + self.digits(7), self.shaped(self.pick("999-99-99999", "9999-99-9999", "99999 99999", "999-999-99999", "99-999-9999-99", "99999999A9", "AA99999999", "999999-999999")))
        return f"{label}{self.pick(': ', ' ', ' = ', '=', ' #', ', ')}{like}{self.pick('', '', ' rows', ' bytes', ' ms', ' times', '%', ' items', ' of ' + self.digits(4), ' ' + self.word())}"

    def capitalised(self) -> str:
        """Words in capitals side by side that name no person."""
        r = self.r
        W = lambda: self.word().title()
        own = self.pick(self.invented(), self.invented(), r.choice(FAMILY), self.given(), W(), self.invented() + r.choice(TOWN_ENDS))
        town = self.pick(self.invented() + r.choice(TOWN_ENDS), self.invented(), self.pick("North", "South", "East", "West", "New", "Saint", "Port", "San", "Upper", "Lower", "Mount", "Lake") + " " + self.invented())
        return self.pick(
            f"{own} {r.choice(ORGANISATION)}", f"{own} {r.choice(ORGANISATION)}", f"{own} {W()} {r.choice(ORGANISATION)}", f"{own} & {self.surname()} {r.choice(ORGANISATION)}", f"The {own} {r.choice(ORGANISATION)}", f"{r.choice(ORGANISATION).rstrip('.')} of {town}",
            f"{own} {r.choice(SITES)}", f"{town} {r.choice(SITES)}", f"{town}, {self.pick('Texas', 'Ohio', 'France', 'Italia', 'UK', 'Bayern', 'Ontario', town)}", f"in {town} and {town}", f"{town} and {town}", f"{own} {r.choice(PRODUCTS)}", f"{own} {W()} {r.choice(PRODUCTS)}",
            f"{W()} {W()}", f"{W()} {W()}", f"{W()} {W()} {W()}", f"{W()}, {W()} and {W()}", f"{self.pick('Mark', 'Will', 'Bill', 'Grant', 'Rob', 'Drew', 'Chase', 'Hope', 'Page', 'Grace', 'May', 'Rose', 'Frank', 'Art', 'Sue', 'Pat', 'Skip', 'Jack', 'Dot', 'Guy', 'Max', 'Tab', 'Tag', 'Ray')} {W()}",
            f"{self.pick('Adaptive', 'Rolling', 'Linear', 'Random', 'Global', 'Hidden', 'Bayesian', 'Gaussian', 'Markov', 'Fourier', 'Poisson', 'Kalman', 'Monte', 'Public', 'Local')} {W()}", f"{W()} {self.pick('Algorithm', 'Method', 'Theorem', 'Filter', 'Distribution', 'Model', 'Test', 'Period', 'Key', 'Window')}",
            " ".join(self.word().upper() for _ in range(r.randint(2, 4))), f"{self.pick('BEGIN', 'END', 'DO', 'SELECT', 'INSERT', 'DROP', 'GROUP', 'ORDER', 'NOT', 'WARNING', 'PUBLIC', 'PRIVATE')} {self.word().upper()} {self.pick('', 'KEY', 'TABLE', 'BY', 'SET')}", f"{W()} {self.digits(2)}",
            f"{self.pick('Monday', 'Friday', 'January', 'March', 'April', 'May', 'June', 'December')} {self.pick('Release', 'Morning', 'Update', W())}", f"{self.given()}, {self.given()} and {self.given()}", f"{self.pick('Apache', 'Mozilla', 'Creative', 'General', 'Lesser', 'Academic')} {W()} {self.pick('License', 'Licence', 'Commons', 'Agreement')}",
            f"{town}", f"{self.given()}", f"{self.surname()}", f"{self.given()}{W()}", f"{W()}{W()} {W()}", f"class {W()}{W()}", f"{own} {self.digits(1)}.{self.digits(1)}", f"{W()} / {W()}", f"{W()}: {W()}", f"{W()}. {W()} {self.words(1, 3)}",
        )

    def machine_address(self) -> str:
        r = self.r
        d, h = ".".join(self.domain()), self.invented().lower()
        return self.pick(
            f"{r.choice(ROLE)}@{d}", f"{r.choice(ROLE)}@{d}", f"{r.choice(ROLE)}@{d}", f"{r.choice(ROLE)}-{r.choice(ROLE)}@{d}", f"{r.choice(ROLE)}.{self.word()}@{d}", f"{self.pick('svc', 'srv', 'sys', 'app', 'usr')}{self.pick('-', '_')}{self.word()}@{d}", f"git@{d}:{self.word()}/{self.word()}.git",
            f"{self.pick('https', 'postgres', 'mysql', 'ftp', 'redis', 'amqp', 'mongodb+srv')}://{self.pick(self.word(), plain(self.given()), 'svc_' + self.word())}:{self.shaped('a9aa9A')}@{d}/{self.word()}", f"ssh {self.pick('root', 'deploy', 'ubuntu', self.word())}@{d}", f"@{self.word()}/{self.word()}@{self.digits(1)}.{self.digits(2)}.{self.digits(1)}",
            f"{self.word()}@{self.digits(1)}.{self.digits(1)}.{self.digits(2)}", f"@{self.word()}.{self.word()}", f"@{self.word().title()}({self.word()})", f"{self.word()}@{h}", f"{r.choice(ROLE)} [at] {self.domain()[0]} [dot] com", f"<{self.hexa(12)}@{d}>", f"{self.word()} at {self.word()} dot {self.word()} {self.word()}",
        )

    def code(self) -> str:
        w, d, f = self.word, self.digits, self.field_word
        W = lambda: self.word().title()
        return self.pick(
            f"const {w()}{W()} = await {w()}.{w()}({{ {w()}: {d(2)} }});", f"if (!{w()}{W()}) throw new {W()}Error('{self.words(1, 4)}');", f"SELECT {f()}, count(*) FROM {f()} WHERE {f()} > {d(4)} {self.pick('AND', 'OR')} {f()} IS NOT NULL", f"INSERT INTO {f()} VALUES ({d(3)}, '{w()}', '{self.words(1, 3)}');",
            f"func ({w()[0]} *{W()}) {W()}({w()} []int) (int, error) {{", f"public static final int {f().upper()} = {d(3)};", f"#define {f().upper()} 0x{self.hexa(4)}", f"<div class=\"{w()}-{w()}\" id=\"{w()}{d(2)}\">{W()} {w()}</div>", f'log.{self.pick("info", "error", "warn")}("{self.words(1, 5)} %d", {w()}.{w()})',
            f"{f()}: [{d(2)}, {d(2)}, {d(2)}]", f"export {f().upper()}={self.shaped('aA9aA9aA9aA9aA9a')}", f"{w()} = {{k: {w()}[k] for k in {w()}}}", f"| {W()} | {W()} | {d(3)} |", f"import {{ {W()}, {W()} }} from '@{w()}/{w()}';", f"GET /{w()}/{w()}/{d(5)} HTTP/1.1", f"Authorization: Bearer {self.shaped('aA9aA9aAaA9aA9aA9aAa9A')}",
            f"uint32_t {w()}[{d(2)}] = {{ 0x{self.hexa(8)}, 0x{self.hexa(8)} }};", f"[{W()}] {w()} {d(4)}", f"{W()} {W()} {d(3)}, {w()} {d(2)}", f"CREATE TABLE {f()} ({f()} INT, {f()} VARCHAR({d(3)}));", f"let {w()}: {W()}<{W()}> = {W()}::new();", f"{d(3)},{d(4)},{w()},{W()},{d(2)}.{d(2)}",
            f"function {w()}{W()}({w()}, {w()}) {{ return {w()}[{w()}]+{d(2)}; }}", f"  - {f()}: {self.pick(w(), W(), d(3))}", f"{self.digits(2)} {self.words(1, 4)}", f"{W()} {d(2)} {W()} {d(2)}", f"step {d(1)} of {d(2)}: {W()} {w()}",
        )

    def negative(self) -> str:
        r, x = self.r, self.r.random()
        if x < 0.22:
            return r.choice(self.lines)
        if x < 0.30:
            s = self.pick(" ".join(r.choice(language) for language in [r.choice(PROSE)] for _ in range(r.randint(3, 9))), self.words(3, 8))
            return self.pick(f"{self.words(2, 5)} {self.digits(r.randint(1, 4))}. {s.capitalize()}{self.pick('.', '')}", f"{self.digits(r.randint(1, 4))}. {s.capitalize()}", s, s, s.capitalize(), f"{self.words(1, 4)}, {s}", f"{self.field_word()} {s}", f"{self.number()}. {s.capitalize()}", f"{self.words(2, 4)} {self.digits(3)}; {s}", f"<p>{self.words(1, 2)} {s}.</p>")
        if x < 0.36:  # numbers before words that make no address of them
            n, W = self.digits(r.randint(1, 4)), self.word().title()
            return self.pick(
                f"{self.words(1, 5)} {n}. {self.words(1, 5).capitalize()}", f"{self.field_word()} {self.pick('>', '<', '=', '>=', '<>')} {n} {self.pick('AND', 'OR', 'AND NOT', 'THEN', 'LIMIT', 'ORDER BY')} {self.field_word()} {self.pick('IS NULL', 'IS NOT NULL', '= ' + self.digits(2), 'IN (', 'LIKE')}",
                f"{{{self.field_word()}: {n}, {self.field_word()}: {self.digits(2)}, {self.field_word()}: {self.digits(3)}}}", f"{n} {self.words(1, 3)} {self.capitalised()}", f"{self.field_word()} {n}, {self.words(1, 2)} {self.capitalised()}", f"{n} to {self.digits(2)} {self.words(1, 3)} {W}",
                f"{n} {self.word()} in {W} {W}", f"{W} {n}, {self.words(1, 3)}", f"{self.words(1, 3)} {W} {n} {self.words(1, 3)}", f"{n}. {self.words(1, 6).capitalize()}",
            )
        if x < 0.40:  # words that are also given names, before capitalised words
            verb = self.pick("Mark", "Will", "Bill", "Grant", "Rob", "Drew", "Chase", "Hope", "Page", "Grace", "May", "Rose", "Frank", "Art", "Sue", "Pat", "Skip", "Jack", "Dot", "Guy", "Max", "Tab", "Ray", "Dean", "Pierce", "Lance", "Miles", "Faith", "Joy", "Summer", "April", "June")
            W = self.word().title()
            return self.pick(f"{verb} {W}", f"{self.words(1, 4)} {verb} {W} {self.words(1, 4)}", f"{verb} {W} {self.words(1, 4)}", f"{verb} {W}, then {self.pick('Will', 'May', 'Mark')} {self.word().title()} {self.words(1, 3)}", f"{self.words(1, 3)}, {verb} {W} {self.digits(2)}", f"the {verb} {W}; {self.words(1, 3)}")
        if x < 0.47:
            return self.pick("", "", self.words(1, 4) + " ") + self.capitalised() + self.pick("", "", " " + self.words(1, 5), ", " + self.words(1, 3), "; " + self.capitalised(), " " + self.capitalised())
        if x < 0.55:  # bare numbers among code
            sep = self.pick(",", ", ", " ", "\t", " | ", ";", "-")
            many = sep.join(self.number() for _ in range(r.randint(1, 4)))
            return self.pick(many, f"{self.words(1, 3)} {many}", f"{self.field_word()}={many}", f"{many} {self.words(1, 3)}", f'{{"{self.shaped("a")}":{self.digits(r.randint(6, 13))},"{self.field_word()}":{self.number()}}}', f"{self.word()} {self.pick('10', '172', '192')}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)} {self.pick('at', 'port', 'took', ':')} {self.digits(r.randint(4, 13))}")
        if x < 0.65:
            return self.pick("", self.words(1, 4) + " ") + self.counted() + self.pick("", "", " " + self.words(1, 4), "; " + self.counted())
        if x < 0.72:
            return self.pick("", self.words(1, 3) + " ", r.choice(LABELS["email"]) + ": ", "remote ", "url = ") + self.machine_address() + self.pick("", " " + self.words(1, 3), " for " + self.words(1, 2))
        if x < 0.74:  # labels of persons before what is none
            kind = r.choice(TYPES)
            return f"{r.choice(LABELS[kind])}{self.pick(': ', ' = ', '=', ': ')}{self.pick(self.words(1, 3), self.capitalised(), self.number(), 'None', 'null', self.word(), self.field_word(), '%s', '{}')}"
        if x < 0.77:
            year = f"{self.pick('19', '20')}{self.digits(2)}"
            return f"{self.pick('Copyright', 'Copyright (c)', '(c)', '©', 'Copyright (C)')} {year}{self.pick('', '-20' + self.digits(2), ',')} {self.pick('The ', '')}{self.pick(self.invented(), self.word().title(), r.choice(FAMILY))} {r.choice(ORGANISATION)}{self.pick('', ' and others', '. All rights reserved.', ' and contributors')}"
        if x < 0.81:
            return f"{self.pick('Licensed under', 'Part of', 'See', 'Powered by', 'Based on', 'Uses', 'From', 'Thanks to', 'Sponsored by', 'Maintained by', 'Made in', 'Tested at', 'Generated by')} {self.pick('the ', '', '')}{self.capitalised()}{self.pick('', ', ' + self.words(1, 4), ' ' + self.words(1, 4))}"
        return self.code()

    # Lines about persons

    def neutral(self) -> str:
        return self.pick(self.number(), self.number(), self.digits(self.r.randint(4, 14)), self.date(), self.word(), self.word().upper(), self.words(1, 3), self.capitalised(), self.digits(3), self.pick("true", "false", "null", "active", "EUR", "USD", "M", "F", "IT", "DE"))

    def positive(self) -> Pieces:
        r, x = self.r, self.r.random()
        who = self.given(), self.surname()
        kind = self.pick("name", "name", "name", "name", "email", "email", "phone", "phone", "national_id", "national_id", "street", "street", "street")
        one = self.entity(kind, who)
        quote = self.pick("", "", '"', "'", "`")
        if x < 0.17:  # a label and its value
            label, sep = r.choice(LABELS[kind]), self.pick(": ", ": ", ": ", " = ", "=", " - ", "\t", ":", " ", " => ", ", ", "  ")
            label = self.pick(label, label, label, label.upper(), label.title(), f"{self.word()}_{label}", f'"{label}"', f"<b>{label}</b>", f"**{label}**")
            one = self.entity(kind, who, True)
            tail = self.pick("", "", "", f" {self.words(1, 4)}", f" ({self.words(1, 2)})", f", {self.words(1, 3)}", f"; {r.choice(OTHER_LABELS)}: {self.neutral()}")
            return [(label + sep + quote, None), one, (quote + tail, None)]
        if x < 0.28:  # a record of columns
            sep = self.pick(",", ", ", ";", "; ", " | ", "\t", "|", ":", " / ", " - ", '","', "','", "', '", '", "')
            edge = '"' if '"' in sep else "'" if "'" in sep else ""
            kinds = r.sample(TYPES, r.randint(1, 3))
            cells: list = [self.entity(k, who) for k in kinds] + [(self.neutral(), None) for _ in range(r.randint(0, 3))]
            r.shuffle(cells)
            lead, tail = self.pick(("", ""), ("", ""), ("| ", " |"), ("(", "),"), ("[", "]"), (f"INSERT INTO {self.field_word()} VALUES (", ");"), (f"{self.word()}(", ")"), ("{", "}"))
            if sep == ", " and any(c[1] == "name" and ", " in c[0] for c in cells):
                sep = "; "
            out: Pieces = [(lead + edge, None)]
            for i, c in enumerate(cells):
                out += [(sep, None), c] if i else [c]
            return [*out, (edge + tail, None)]
        if x < 0.40:  # an object of keys and values
            q, eq, sep = self.pick(('"', ": ", ", "), ('"', ":", ","), ("'", ": ", ", "), ("", "=", ", "), ("", "=", " "), ("", ": ", "; "), ("", "=", "&"), ("", ": ", " "))
            kinds = r.sample(TYPES, r.randint(1, 4)) + [None] * r.randint(0, 2)
            r.shuffle(kinds)
            out = [(self.pick("{", "", "  {", f"{self.word()}(", "[{", f"{self.word().title()}({self.digits(2)}, ") if eq != "&" else "?", None)]
            for i, k in enumerate(kinds):
                known = r.random() < 0.7
                label = (r.choice(LABELS[k]) if known else self.shaped("a")) if k else self.field_word()
                v = self.entity(k, who, known) if k else (self.neutral(), None)
                inner = self.pick('"', '"', "'") if not q and r.random() < 0.5 else q
                out += [((sep if i else "") + q + label + q + eq + inner, None), v, (inner, None)]
            return [*out, (self.pick("}", "},", ")", "", "}]"), None)]
        if x < 0.48:  # heads of files, commits and letters
            n, e = self.entity("name", who), self.entity("email", who)
            year = f"{self.pick('19', '20')}{self.digits(2)}"
            return self.pick(
                [(r.choice(LABELS["name"]) + self.pick(": ", " "), None), n, (" <", None), e, (">", None)], [n, (" <", None), e, (">", None)], [n, (" (", None), e, (")", None)], [(f"{self.pick('Copyright', 'Copyright (c)', '(c)', '©', 'Copyright (C)')} {year}{self.pick('', '-20' + self.digits(2), ',')} ", None), n, (self.pick("", ". All rights reserved.", ", " + self.words(1, 3), " and others"), None)],
                [(f"{year}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}  ", None), n, ("  <", None), e, (">", None)], [(f"* {self.words(1, 4)} (", None), n, (")", None)], [("\\author{", None), n, ("}", None)], [('<a href="mailto:', None), e, ('">', None), n, ("</a>", None)], [('<a href="tel:', None), self.entity("phone", who), ('">', None), self.pick(n, ("call", None)), ("</a>", None)],
                [(f"commit {self.hexa(12)} ", None), n], [("Dear ", None), n, (",", None)], [(f"From: {quote}", None), n, (f"{quote} <", None), e, (">", None)], [(f"[{self.word()}] ", None), n, (f": {self.words(2, 5)}", None)], [(f"<{self.word()}>", None), n, (f"</{self.word()}>", None)], [(f"<{kind}>", None), one, (f"</{kind}>", None)],
                [("BEGIN:VCARD FN:", None), n, (" TEL:", None), self.entity("phone", who)], [n, (", ", None), self.entity("street", who), (f", {self.digits(5)} {self.invented()}", None)], [self.entity("street", who), (self.pick(", ", "; ") + self.pick(self.digits(5) + " ", "") + self.invented() + self.pick("", ", " + self.capitals(2) + " " + self.digits(5)), None)],
                [(f"{self.digits(2)}:{self.digits(2)}:{self.digits(2)} {self.pick('INFO', 'WARN', 'ERROR', 'DEBUG')} {self.words(1, 3)} {self.pick('user', 'login', 'email', 'for', 'from', 'account')}{self.pick('=', ' ', ': ')}", None), self.pick(e, e, one), (self.pick("", f" {self.word()}={self.digits(3)}", f" {self.words(1, 3)}"), None)],
            )
        if x < 0.53:
            return [one]
        if x < 0.58:  # a call, comparison or assignment
            fn = self.pick(self.word(), f"{self.word()}_{self.word()}", f"{self.word()}.{self.word()}", f"self.{self.word()}", f"assert {self.word()}", f"{self.word().title()}{self.word().title()}")
            q = self.pick('"', "'", "`")
            return self.pick(
                [(f"{fn}({q}", None), one, (f"{q}{self.pick(')', ');', ', ' + self.digits(2) + ')', ', ' + self.word() + '=None)')}", None)], [(f"{fn} = {q}", None), one, (f"{q}{self.pick('', ';')}", None)], [(f"{self.field_word()} == {q}", None), one, (q, None)],
                [(f"{fn}({q}", None), one, (f"{q}) == {q}", None), self.entity(r.choice(TYPES), who), (q, None)], [(f"[{q}", None), one, (f"{q}, {q}", None), self.entity(kind, (self.given(), self.surname())), (f"{q}]", None)],
            )
        # sentences: words, a person or what belongs to one, words
        n = self.entity("name", who)
        before = self.pick("", "", self.words(1, 6) + " ", self.words(1, 6) + " ", f"{self.words(1, 3)} {self.digits(r.randint(1, 4))}, {self.word()} ", f"{self.words(1, 3)} #{self.digits(3)} ", self.words(1, 4) + self.pick(". ", ", ", "; ", ": "))
        link = self.pick("", "", r.choice(BEFORE_PERSON).replace("_", " ") + " ")
        after = self.pick("", "", " " + r.choice(AFTER_PERSON).replace("_", " "), self.pick(",", ".", ";", ":", "'s", " -", ")", "?", "/"))
        end = self.pick("", "", " " + self.words(1, 6))
        if r.random() < 0.45:
            title = r.choice(TITLES) + " " if r.random() < 0.12 else ""
            more: Pieces = []
            if r.random() < 0.45:
                more = [(self.pick(" and ", ", ", " or ", " & ", " / ", ", and ", "; ", " with "), None), self.entity("name", (self.given(), self.surname()))]
            if r.random() < 0.3:
                k = self.pick("phone", "email", "street", "national_id")
                more += [(self.pick(" on ", " at ", ", ", " (", ": ", ", tel. ", " via ", " under ", " of ", ", " + r.choice(LABELS[k]) + " ", " / "), None), self.entity(k, who)]
            return [(before + link + title, None), n, *more, (after + end, None)]
        link = {
            "name": link, "email": self.pick("mail ", "write to ", "send it to ", "reach me at ", "contact ", "cc ", "ask ", "", "by email: ", "login ", "user "), "phone": self.pick("call ", "ring ", "tel. ", "phone ", "on ", "at ", "dial ", "text ", "fax ", "", "number is "),
            "national_id": self.pick(r.choice(LABELS["national_id"]) + " ", r.choice(LABELS["national_id"]) + " is ", "with " + r.choice(LABELS["national_id"]) + " ", "holder ", "registered under ", "the number "), "street": self.pick("at ", "to ", "from ", "lives at ", "near ", "visit ", "send to ", "moved to ", "in ", "office at ", "deliver to ", "")}[kind]
        return [(before + link, None), one, (self.pick(after, "", ",", ".", " or", " and") + end, None)]

    def line(self) -> Pieces:
        body = self.positive() if self.r.random() < 0.6 else [(self.negative(), None)]
        if self.r.random() < 0.12:
            body = [*body, (self.pick("  ", " # ", "; ", " // ", " "), None), *(self.positive() if self.r.random() < 0.4 else [(self.negative(), None)])]
        return [(self.r.choice(LEADS), None), *body, (self.r.choice(TRAILS), None)]

    def window(self, most: int) -> tuple[str, list[tuple[int, int, str]]]:
        """A line of at most this length, cut somewhere outside spans if too long, and its spans."""
        text, found = "", []
        for s, kind in self.line():
            if len(text) + len(s) > most:
                if kind is None:
                    text += s[: most - len(text)]
                break
            if kind:
                found.append((len(text), len(text) + len(s), kind))
            text += s
        return (text, found) if text else self.window(most)
