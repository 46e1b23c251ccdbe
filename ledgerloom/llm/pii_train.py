"""Trains pii_model.json: ``python -m ledgerloom.llm.pii_train FOLDER`` (documents.parquet in FOLDER).

Ordinary lines and words come from the documents of FOLDER (at most LINES lines, spread evenly), a
table in which nothing is looked for; personal information, always invented, is put between and into
them, with look-alikes that are none. The labels are therefore known. Numbers, addresses and mails
follow public conventions (national numbering plans, forms of identity numbers, postal habits);
names, streets and towns are made up from syllables so that the model learns forms and
surroundings, not the names. No sentence here occurs in the tables that are searched (tested).
"""

from __future__ import annotations

import json
import math
import random
import re
import sys
from collections.abc import Iterator
from collections import Counter

from ledgerloom.llm.pii import GIVEN, KIND_NUMBER, KINDS, MODEL, STREETS, STREETS_LARGE, TITLES, Model, Window, windows

LINES = 40_000
EXAMPLES = 60_000
EPOCHS = 5
RATE = 0.25
L2 = 2e-5

SYLLABLES = "ash bar bren cal cor dal den dor el fen gar hal har iver jur kal kov kron lam lav lin lor mar mir mont nak ob ok os pen per quil ren rin sol stav tam thorn tor ul van vel wex win wol zem".split()
TAILS = "berg bom bury by combe dale dry feld gate giri grove holm holz ins ket kett ley low man marsh mir nek nyi pool port quist ra reece rier ridge roux sen shaw sky smith son stead sted strom thorpe ton vang varn ville wald wick".split()
CARRIERS = {
    "person": ["Please forward this to {} today.", "{} will join us at noon.", "We met {} at the fair.", "Yesterday {} agreed to the plan.", "Any questions? Speak to {}.", "{} is out of office until Thursday.", "The complaint came from {}.", "Dear {},", "Hello {},", "Hi {}, any news?", "Kind regards,\n{}", "Sincerely,\n{}", "Yours,\n{}", "Viele Grüße\n{}", "Un saludo,\n{}", "Cordialement,\n{}", "{} hat heute Urlaub.", "Wir haben mit {} telefoniert.", "Hablé con {} por la tarde.", "{} llegará el martes.", "J'ai vu {} hier matin.", "{} sera absente demain.", "as {} told me, it works", "A note for {}", "Approved by {} yesterday", "Lunch with {}", "Onboarding of {}", "Complaint from {}", "{} (finance)", "written by {} in May", "my colleague {} found it", "{} wrote:", "on behalf of {}", "Frag bitte {}.", "Pregunta a {}.", "Demande à {}.", "{} and the rest of us agree", "{}'s laptop was replaced"],
    "email": ["Write to {} for access.", "You can reach us via {}.", "My address is {}, write any time.", "It was sent on from {} last night.", "A reset link went out to {}", "contact {} or come by", "{} was full again", "<{}>", "({})", '"{}"', "Invite {} as a guest", "Schreiben Sie uns an {}.", "Puedes escribirme a {}.", "Vous pouvez écrire à {}.", "mail {} about it", "sign {} up for news", "account {} is locked", "Add {} in copy."],
    "phone": ["You can call me on {}.", "Dial {} and ask for support.", "Ring {} before noon.", "Her mobile is {} now.", "text me: {}", "callback number {}", "Sie erreichen uns unter {}.", "Rufen Sie {} an.", "Llámame al {}.", "Appelez-moi au {}.", "voicemail from {}", "WhatsApp {}", "Missed call from {}", "hotline {}", "{} (office)", "No answer from {} today", "the number {} is engaged", "leave a message at {}", "Meine Nummer ist {}.", "My new number: {}"],
    "id_number": ["The number {} was in the upload.", "Found {} in plain text.", "Delete {} before you publish", "The value {} should be masked.", "field 4 = {}", "Her file lists {}.", "{} belongs to a real person", "They typed {} into the chat.", "customer gave {} for the check", "{} was scanned twice", "Bitte {} schwärzen.", "Borra {} del registro.", "Il faut masquer {}."],
    "address": ["Ship it to {}", "Deliver to:\n{}", "Our office is at {}.", "She moved to {} in May.", "I live at {} these days.", "Pick it up from {} please.", "Send it to {} instead.", "Unsere Adresse lautet {}.", "Sie wohnt jetzt {}.", "Vivo en {}.", "J'habite au {}.", "Visit us: {}", "The shop at {} is closed.", "Return to sender: {}", "Meet me at {} at six", "map of {}", "a courier waits at {}", "Package left at {}"],
}
#: How letters and messages end.
CLOSINGS = "Thanks|Thank you|Many thanks|Regards|Best|Best wishes|Cheers|Danke|Mit besten Grüßen|Gracias|Saludos|Merci|Bien à vous|Ciao"
#: Names of fields, and what stands between such a name and its value.
LABELS = {
    "person": "Name|Full name|Contact|Attn|Customer|Employee|Author|Owner|Assignee|Reporter|Applicant|Kunde|Ansprechpartner|Nombre|Nom|Signed|Manager|name|owner|author|contact|user",
    "email": "Email|E-mail|Mail|To|From|Reply-To|Cc|Correo|Courriel|email|mail|user_email|login|recipient",
    "phone": "Phone|Tel|Tel.|Telephone|Mobile|Cell|Fax|Telefon|Handy|Teléfono|Tél.|phone|mobile|fax|phone_number",
    "id_number": "ID|ID number|Document no.|National ID|Ausweis|Documento|Pièce d'identité|Tax ID|id_no|national_id|tax_id|document|ssn",
    "address": "Address|Home address|Ship to|Bill to|Anschrift|Adresse|Dirección|Domicilio|address|street|billing_address|shipping",
}
#: What numbers that belong to nobody are called.
COUNTED = "order|order number|order id|invoice|invoice number|ticket|tracking number|parcel|serial number|part number|article|SKU|case|booking|reference|batch|build|barcode|ISBN|epoch|timestamp|unix time|offset|checksum|uid|pid|port|row|line|id|size|matrix size|range|interval|version|commit|request|job|run|seed|hash|budget|quota|amount|total|units|bytes|key|index|sample|record"
BETWEEN = (": ", ": ", "=", " = ", " - ", " | ", "; ", "\t", '": "', ",", ":\n")
#: Several things together, as on cards, in signatures and in tables.
TOGETHER = ["{person}\n{address}\n{phone}", "{person}\n{email}", "{person} <{email}>", "{person}, {phone}", "{person};{email};{phone}", "{person} | {id_number}", "{person}, {address}", "{email} / {phone}", "{person}\n{phone}\n{email}", "{person} ({email})", "{person} and {person}", "{person}, {person} and {person}", "{id_number} {person}", "name={person} phone={phone}"]
NOBODY = ["nobody", "someone", "our team", "everybody", "{n}", "{hex}", "{path}", "{ident}", "the {adj} {noun} {noun2}", "{noun}", "the {noun} {noun2}", "main", "root", "{Odd}", "{odd}", "support", "all staff", "the client"]
LOOKALIKES = [
    "Order no. {n10} has shipped", "order number: {n9}", "Your order id is {n10}.", "order {n11} came late", "order {n10}, open", "tracking number {n12}", "parcel {n11}", "invoice {n8}", "Invoice no. {n4}-{n5}", "purchase order {n10}", "serial no. {n9}", "SKU {n3}-{n4}", "part no. {n3}-{n3}-{n4}", "part {n3}-{n2}-{n4} is sold out", "a {n3}-{n2}-{n4} bearing", "case no. {n7}", "case {n9}", "booking {n10}", "reference {n9}", "account ref {n8}", "batch {n10}", "ISBN 978-{n}-{n2}-{n6}-{n}", "barcode 40{n11}",
    "build {n4}.{n2}.{n3}", "v{n1}.{n2}.{n3} is out", "release {n2}.{n1}.{n4}", "IP 10.{n2}.{n3}.{n1}", "ping 192.168.{n2}.{n2}", "bind to 0.0.0.0:{n4}", "port {n5} is taken", "unix time {e}", "ts={e}", "at {e} ms", "created {e}", "id={hex}", "sha {hex}", "blob {hex}-{n4}-{n4}-{hex}", "uuid {hex}-{n4}-4{n3}-{n4}-{n12}", "20{n2}-0{n1}-1{n1} 0{n1}:{n2}:{n2}", "20{n2}-0{n1}-1{n1}T1{n1}:{n2}:{n2}.{n3}", "seen 20{n2}-1{n1}-0{n1}", "rows {n4} to {n4}", "{n3}-{n4} of {n5} rows", "between {n3} and {n4}-{n4}", "offset {n8}", "{n9} bytes", "{n10} bytes free", "took {n5} ms", "{n3} {n3} {n3} records", "sum 0.{n9}", "{n4}x{n4} pixels", "{n3} x {n3} x {n2}", "pages {n2}-{n3}", "0x{n8}", "checksum {n10}", "uid {n6}", "pid={n6}", "PR {n4} and {n4}", "see {n5}, {n5}", "EUR {n3}.{n2}", "phase {n3}-{n3}", "REQ-{n4}-{n4}", "matrix {n2} {n2} {n2} {n2}", "limits {n3}/{n4}/{n4}", "quota {n3}-{n3}-{n4} units", "memory at {n7}",
    "{n3} street scenes in the set", "lane {n2}, blocked", "line {n3} lane change", "drive {n2} failed", "the {Odd} drive {n2}", "close {n3} windows", "court {n2} is free", "road map {n4}", "the {n2} way split", "square {n2}", "street view {n3}", "avenue {n1} of attack",
    "the {Town} office", "the {Town} cluster", "the {Town} region", "server {given}-{n2}", "host {given}{n2} is down", "{given}-db-{n2} rebooted", "deploy to {given}", "machines {given}-a and {given}-b", "{Given} {n1}.{n1} came out", "the {Given} release", "release {Town} {n1}.{n1}", "Project {Town}", "project {Odd} {Odd} starts", "codename {Given}", "the {Given} printer", "the {Given} library is old", "our {Given} model", "{Given} Studio crashed", "{Town} {Odd} Edition", "Team {Town}", "{Odd} {Odd} conference", "{Town} Airport", "the {Town} {Noun} project", "the {Noun} {Noun} suite", "The {Odd} {Noun} is new",
    "git@host.test:{given}/{noun}.git", "git clone git@{noun}.test:{given}/{noun2}.git", "origin git@{odd}.test:{odd}/{noun}.git", "npm i {ident}@{n1}.{n1}.{n2}", "{ident}@{n1}.{n2}.{n3} has a bug", "{noun}@{n1}.{n2}.{n3}", "pin {noun}@{n1}.{n2}", "@{noun}/{noun2}@{n1}.{n1}", "{noun}@sha256:{hex}", "{ident}@{noun}", "key {noun}@{noun2}", "image {noun}:{n1}.{n1}@{hex}", "@{noun} wraps it", "@{noun}.{odd} {noun2}", "look at {noun} dot {noun2}",
    "install {odd}", "the {odd} {noun}", "{Odd} is a {adj} {noun}", "{Odd} and {Odd} compared", "switch from {Odd} to {Odd}", "{odd}.{odd}()", "run {odd} --{noun}", "{Odd}: {noun}", "{Odd} {noun} {n1}", "using {Odd} for {noun}", "with {Odd}, {Odd} or {odd}", "{odd} {odd} {noun}", "{Odd} {noun}", "{noun} {Odd} {noun2}", "fix {odd} in {path}", "{Odd} {adj} {noun}.", "a {adj} {odd}", "in {Odd} we {noun}", "{Odd}", "{odd}", "- {Odd}", "{Odd} {Noun}", "{Noun} {Odd}", "{Noun} {Noun}", "{Noun} for {Odd} {n4}", "{noun} {n2} {Odd}, {noun} {n3} {Odd}", "{Noun} {n2} {Odd} is {adj}", "project {Odd} {Odd} needs {Odd} {Odd}", "{Odd} {Odd} uses {Odd} {Odd} {n1}", "ALL {NOUN} {NOUN}", "{ODD} {NOUN}",
]


class Invent:
    """Invented personal information and fillings, all from one seed."""

    def __init__(self, seed: int, nouns: list[str], adjectives: list[str]):
        self.r = random.Random(seed)
        self.nouns, self.adjectives = nouns, adjectives
        self.given = sorted(GIVEN)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def surname(self) -> str:
        if self.r.random() < 0.06:  # given names and names of two or three letters are surnames, too
            return (self.r.choice(self.given) if self.r.random() < 0.5 else self.r.choice(SYLLABLES)[:3]).capitalize()
        name = "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2)))) + self.r.choice(TAILS)
        name = name.capitalize()
        if self.r.random() < 0.08:
            name += "-" + (self.r.choice(SYLLABLES) + self.r.choice(TAILS)).capitalize()
        if self.r.random() < 0.06:
            name = name.replace("o", "ø", 1).replace("a", "á", 1)
        return name

    def first(self) -> str:
        return (self.r.choice(self.given) if self.r.random() < 0.75 else self.r.choice(SYLLABLES) + self.r.choice(("a", "o", "ine", "us", "ette", "ik"))).capitalize()

    def person(self) -> str:
        f, s, r = self.first(), self.surname(), self.r.random()
        if r > 0.57 and self.r.random() < 0.08:  # after a title, an initial or a given name an ordinary word is a name
            s = self.r.choice(self.nouns + sorted(STREETS)).capitalize()
        name = f"{f} {s}" if r < 0.45 else f"{s}, {f}" if r < 0.57 else f"{f[0]}. {s}" if r < 0.69 else f"{f} {self.r.choice('ABCDHKLM')}. {s}" if r < 0.79 else f"{self.r.choice(('Mr.', 'Ms', 'Mrs', 'Dr.', 'Prof.', 'Frau', 'Herr', 'Señora', 'Mme'))} {s}" if r < 0.92 else s
        return name.upper() if self.r.random() < 0.08 else name.lower() if self.r.random() < 0.12 and ("." not in name) and " " in name else name

    def email(self) -> str:
        f, s, r = self.first().lower(), self.surname().lower().split("-")[0], self.r.random()
        local = f if r < 0.1 else f"{f}.{s}" if r < 0.3 else f"{f}-{s}" if r < 0.4 else f"{f}_{s[:4]}{self.digits(2)}" if r < 0.55 else f"{f[0]}{s}" if r < 0.7 else f"{s}{self.digits(2)}" if r < 0.85 else f"{s}.{f[0]}+{self.r.choice(self.nouns)}"
        parts = self.r.choice(("example.org", "example.com", "example.net", "mail.example.org", f"{s}.example", f"{s}.{self.r.choice(('com', 'org', 'de', 'fr', 'es', 'io', 'co.uk', 'test', 'invalid'))}", f"{self.r.choice(SYLLABLES)}{self.r.choice(TAILS)}.{self.r.choice(('com', 'net', 'de', 'jp'))}", f"{self.r.choice(SYLLABLES)}-{self.r.choice(TAILS)}.{self.r.choice(('example', 'test', 'org'))}")).split(".")
        form = self.r.random()
        if form < 0.72:
            mail = f"{local}@{'.'.join(parts)}"
            mail = mail.upper() if self.r.random() < 0.06 else mail.title() if self.r.random() < 0.06 else mail
        elif form < 0.78:
            mail = f"{local}＠{'.'.join(parts)}"
        elif form < 0.84:
            mail = f"{local}%40{'.'.join(parts)}"
        else:
            mail = local + self.r.choice((" (at) ", " [at] ", " at ")) + self.r.choice((" dot ", " (dot) ", " [dot] ")).join(parts)
        return mail

    def phone(self) -> str:
        """Numbers of the North American plan, and of Britain, Germany, France, Spain, Italy and Japan, at home and abroad."""
        d, c = self.digits, self.r.choice
        a, b, e = c("23456789") + d(2), c("23456789") + d(2), d(4)
        north = [f"({a}) {b}-{e}", f"{a}-{b}-{e}", f"{a}.{b}.{e}", f"{a} {b} {e}", f"+1 {a} {b} {e}", f"+1-{a}-{b}-{e}", f"+1 ({a}) {b}-{e}", f"1-{a}-{b}-{e}", f"{a}{b}{e}", f"+1{a}{b}{e}", f"({a}) {b}-{e} x{d(3)}", f"{a}-{b}-{e} ext. {d(2)}", f"+1-{a}-{b}-{e} x{d(2)}"]
        britain = [f"+44 20 {e} {d(4)}", f"+44 (0)20 {e} {d(4)}", f"020 {e} {d(4)}", f"07{d(3)} {d(6)}", f"07{d(9)}", f"+44 7{d(3)} {d(6)}", f"01{d(3)} {d(6)}", f"+447{d(9)}"]
        germany = [f"+49 {c(('30', '40', '89', '221'))} {d(5)} {d(3)}", f"+49 (0)30 {d(5)}-{d(3)}", f"0{c(('30', '40', '89', '221'))} {d(5)} {d(3)}", f"0{d(3)}/{d(6)}", f"+49 17{d(1)} {d(7)}", f"017{d(1)} {d(7)}", f"0{d(3)}-{d(7)}"]
        others = [f"+33 {c('1234567')} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{c('1234567')} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{c('1267')}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+34 {c('69')}{d(2)} {d(3)} {d(3)}", f"{c('69')}{d(2)} {d(3)} {d(3)}", f"+39 06 {d(4)} {d(4)}", f"+81 3 {d(4)} {d(4)}", f"03-{d(4)}-{d(4)}", f"+81-90-{d(4)}-{d(4)}"]
        group = c((north, north, britain, germany, others))
        number = c(group)
        return number + c((f" x{d(3)}", f" x{d(2)}", f" ext. {d(3)}")) if group is north and "x" not in number and self.r.random() < 0.12 else number

    def id_number(self) -> tuple[str, str]:
        """(what names the number, the number): social security, tax, national identity, passport and licence numbers of several countries."""
        d, c = self.digits, self.r.choice
        L = lambda n=1: "".join(c("ABCDEFGHJKLMNPRSTWXYZ") for _ in range(n))
        forms = {
            "SSN|social security number|Social Security no.|ssn|ITIN": [f"{d(3)}-{d(2)}-{d(4)}", f"9{d(2)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9)],
            "NI number|National Insurance number|NINO": [f"{L(2)}{d(6)}{c('ABCD')}", f"{L(2)} {d(2)} {d(2)} {d(2)} {c('ABCD')}", f"QQ{d(6)}{c('ABCD')}", f"QQ {d(2)} {d(2)} {d(2)} {c('ABCD')}"],
            "DNI|NIF|documento": [f"{d(8)}{L()}", f"{d(8)}-{L()}", f"{d(2)}.{d(3)}.{d(3)}-{L()}", f"{d(2)}.{d(3)}.{d(3)}{L()}"],
            "NIE": [f"{c('XYZ')}{d(7)}{L()}", f"{c('XYZ')}-{d(7)}-{L()}"],
            "Steuer-ID|tax id|Tax number|TIN|Steuernummer": [f"{d(2)} {d(3)} {d(3)} {d(3)}", d(11), f"{d(2)}-{d(7)}", f"{d(3)}/{d(3)}/{d(5)}"],
            "passport|passport no.|Passport number|Reisepass|pasaporte|passeport": [f"{L()}{d(7)}", f"{L()}{d(8)}", f"{L(2)}{d(6)}", f"{L(2)}{d(7)}", f"{L()}{d(2)}{L(2)}{d(4)}", d(9)],
            "driver's license|driving licence no.|licence number|DL|Führerschein|permiso": [f"{L()}{d(7)}", f"{L()}{d(3)}-{d(4)}-{d(4)}", f"{L()}{d(12)}", f"{L()}{d(3)}-{d(3)}-{d(3)}-{d(3)}", f"{L(5)}{d(6)}{L(2)}{d(1)}{L(2)}"],
            "national ID|ID card|Personalausweis|personnummer|INSEE|NIR|SIN|My Number|codice fiscale": [f"{d(6)}-{d(4)}", f"{L()}{d(2)}{L()}{d(5)}", f"{c('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{d(3)} {d(3)} {d(3)}", f"{d(4)} {d(4)} {d(4)}", f"{L(6)}{d(2)}{L()}{d(2)}{L()}{d(3)}{L()}"],
        }
        names = c(list(forms))
        return c(names.split("|")), c(forms[names])

    def street(self) -> str:
        name = self.r.choice(("High", "Church", "Station", "Park", "Victoria", "King's", "Old Mill", "North", "West End", "First")) if self.r.random() < 0.3 else (self.r.choice(SYLLABLES) + self.r.choice(TAILS)).capitalize()
        return name + (" " + self.r.choice(TAILS).capitalize() if self.r.random() < 0.15 else "")

    def town(self) -> str:
        t = (self.r.choice(SYLLABLES) + self.r.choice(TAILS)).capitalize()
        return self.r.choice(("Port ", "Saint-", "Bad ", "New ", "San ", "North ")) + t if self.r.random() < 0.25 else t

    def address(self) -> str:
        """House numbers before or behind the street, with flats, post codes and towns, as in English, German, French and Spanish."""
        d, c, s, t = self.digits, self.r.choice, self.street(), self.town()
        w = s.split()[0].rstrip("'s")
        n, z = str(self.r.randrange(1, 999)), d(5)
        kind = c(("Street", "St.", "St", "Road", "Rd", "Rd.", "Avenue", "Ave", "Ave.", "Lane", "Ln", "Drive", "Court", "Close", "Terrace", "Blvd", "Crescent", "Way", "Place", "Square"))
        code = c((z, f"{c('ABELMNS')}{d(1)} {d(1)}{c('ABDH')}{c('ELPW')}", f"{c(('CA', 'NY', 'TX', 'OH'))} {z}"))
        english = [f"{n} {s} {kind}", f"{n} {s} {kind}, {t}", f"{n}{c('ABC')} {s} {kind}", f"{n} {s} {kind}, {t} {code}", f"{n} {s} {kind}, {t}, {code}", f"{n} {s} {kind}, {c(('Apt', 'Apt.', 'Flat', 'Suite', 'Unit'))} {d(1)}{c(('', 'B', '2'))}, {t} {code}", f"{n} {s} {kind}\n{t} {code}", f"{n} {s} {kind}\n{t}", f"{c(('Flat', 'Unit', 'Suite'))} {d(1)}, {n} {s} {kind}, {t}", f"{n} {s} {kind} {c(('Apt', '#'))} {d(2)}", f"{s} {kind} {n}", f"{s} {kind} {n}, {t}", f"{c(('P.O. Box', 'PO Box'))} {n}, {t} {code}", f"{c(('P.O. Box', 'PO Box'))} {n}", f"{n} {c(('N', 'S', 'East', 'West'))} {s} {kind}, {t}", f"{n} {s} {kind}\n{c(('Apt', 'Flat'))} {d(2)}\n{t} {code}"]
        german = [f"{w}{c(('straße', 'strasse', 'str.', 'weg', 'gasse', 'platz', 'allee', 'ring'))} {n}", f"{w}{c(('straße', 'str.', 'weg', 'gasse', 'platz'))} {n}, {z} {t}", f"{w}{c(('straße', 'weg'))} {n}{c('abc')}, {t}", f"{w}{c(('straße', 'weg', 'allee'))} {n}\n{z} {t}", f"{w}er {c(('Straße', 'Weg', 'Platz', 'Allee', 'Ring', 'Damm'))} {n}, {z} {t}", f"{c(('Am', 'Im', 'An der', 'Auf dem', 'Zum'))} {c(('', 'Hohen ', 'Neuen ', 'Kleinen '))}{w} {n}{c(('', 'a', 'b'))}{c((', ', ' in '))}{z} {t}", f"{c(('Am', 'An der', 'Im', 'Zum'))} {c(('Hohen ', 'Neuen ', ''))}{c(('Markt', 'Ufer', 'Damm', 'Ring', 'Platz'))} {n}{c(('', 'a'))}{c((', ', ' in '))}{z} {t}"]
        french = [f"{n} {c(('rue', 'avenue', 'boulevard', 'chemin', 'quai', 'place', 'impasse'))} {c(('de', 'du', 'des', 'de la'))} {c(('', 'Grand ', 'Petit ', 'Saint-'))}{w}, {z} {t}", f"{n}{c(('', ' bis', ' ter'))}, {c(('rue', 'avenue', 'chemin'))} {c(('de', 'du', 'des'))} {c(('', 'Grand ', 'Petit '))}{w}, {t}", f"{n} {c(('rue', 'allée'))} {w}\n{z} {t}", f"{n} rue {w}"]
        spanish = [f"{c(('Calle', 'Avenida', 'Plaza', 'Paseo', 'Camino'))} {c(('', 'de ', 'del ', 'de la '))}{w} {n}, {z} {t}", f"{c(('Calle', 'Avenida'))} {c(('', 'de ', 'del '))}{w}, {n}, {d(1)}{c(('º', '.º', '°'))} {c('ABC')}, {t}", f"Calle {w} {n}", f"{c(('C/', 'Av.', 'Avda.'))} {w} {n}, {t}" if self.r.random() < 0.01 else f"Calle {w} {n}, {t}", f"{c(('Via', 'Viale', 'Piazza', 'Corso'))} {w} {n}, {z} {t}"]
        a = c(c((english, english, english, german, french, spanish)))
        return a.lower() if self.r.random() < 0.06 else a.upper() if self.r.random() < 0.03 else a

    def foreign(self, least: int, most: int) -> str:
        """Words of a language no list knows."""
        return " ".join(self.odd() for _ in range(self.r.randrange(least, most + 1)))

    def counted(self) -> str:
        """A number that belongs to nobody, with what says so."""
        d, c = self.digits, self.r.choice
        shape = c((d(self.r.randrange(6, 14)), d(self.r.randrange(8, 12)), f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(7)}", f"{d(2)}-{d(7)}", f"{d(3)}-{d(4)}", f"{d(2)}-{d(3)}-{d(4)}", f"{d(3)} x {d(3)} x {d(4)}", f"{d(4)}-{d(4)}-{d(4)}", f"{self.odd()[:3].upper()}-{d(self.r.randrange(2, 5))}-{d(self.r.randrange(2, 5))}", f"{d(2)}.{d(2)}.{d(4)} {d(2)}:{d(2)}"))
        cue = c(COUNTED.split("|"))
        return (cue.capitalize() if self.r.random() < 0.3 else cue) + c((" ", " ", ": ", " is ", " = ", "=", " #", " no. ", " (")) + shape + c(("", "", " " + c(self.nouns), " is " + c(self.adjectives), ", " + c(self.nouns), ".", " was " + c(self.adjectives)))

    def paved(self) -> str:
        """Words of streets that are none."""
        c = self.r.choice
        word = lambda: c(sorted(STREETS | STREETS_LARGE)).capitalize()
        return c((f"{self.digits(2)} {word()} {c(self.nouns)}", f"{c(self.nouns)} {self.digits(2)} {word()} and {c(self.nouns)} {self.digits(3)} {word()} are {c(self.adjectives)}", f"{word()} {c(self.nouns)} {self.digits(2)}", f"the {word().lower()} {self.digits(2)} {c(self.nouns)}", f"{c(self.nouns)} {self.digits(3)} {word()} {c(self.nouns)}"))

    def ident(self) -> str:
        parts = [self.r.choice(SYLLABLES)[:3] for _ in range(3)]
        return self.r.choice(("_".join(parts), parts[0] + "".join(p.capitalize() for p in parts[1:]), "".join(p.capitalize() for p in parts[:2]), "-".join(parts[:2])))

    def odd(self) -> str:
        """A word no list has: a slip, a tool, a product."""
        return "".join(self.r.choice(SYLLABLES) for _ in range(2)) if self.r.random() < 0.5 else (w := self.r.choice(self.nouns))[: self.r.randrange(2, 4)] + w[self.r.randrange(1, 3) :]

    def fill(self, form: str) -> str:
        c = self.r.choice

        def one(m: re.Match) -> str:
            key = m.group(1)
            if re.fullmatch(r"n\d+", key):
                return "123456789"[self.r.randrange(9)] + self.digits(int(key[1:]) - 1)
            return {"n": lambda: self.digits(self.r.randrange(1, 5)), "e": lambda: "17" + self.digits(self.r.randrange(8, 13)), "hex": lambda: "%x" % self.r.getrandbits(40), "path": lambda: f"{c(('src', 'lib', 'core/io', 'tests'))}/{self.ident()}.py", "ident": self.ident, "Given": lambda: self.first(), "given": lambda: self.first().lower(), "Town": self.town, "odd": self.odd, "ODD": lambda: self.odd().upper(), "Noun": lambda: c(self.nouns).capitalize(), "NOUN": lambda: c(self.nouns).upper(), "Odd": lambda: self.odd().capitalize(), "noun": lambda: c(self.nouns), "noun2": lambda: c(self.nouns), "adj": lambda: c(self.adjectives)}[key]()

        return re.sub(r"\{(\w+)\}", one, form)

    def example(self, line: callable) -> tuple[str, list[tuple[int, int, str]]]:
        """A text with the places of what was put into it."""
        parts, gold, size = [], [], 0

        def add(text: str, spans: tuple = ()) -> None:
            nonlocal size
            gap = "" if not parts else self.r.choice((" ", " ", "\n", "\n", "\n\n"))
            for a, z, kind in spans:
                gold.append((size + len(gap) + a, size + len(gap) + z, kind))
            parts.append(gap + text)
            size += len(gap) + len(text)

        def made(kind: str, alone: bool) -> tuple[str, int]:
            """One invented thing, and where it starts behind what names it."""
            if kind != "id_number":
                return getattr(self, kind)(), 0
            named, number = self.id_number()
            if alone or self.r.random() < 0.3:
                return number, 0
            lead = named + self.r.choice((" ", ": ", " ", "=", " is "))
            return lead + number, len(lead)

        def put(form: list[str], kinds: list[str], alone: bool = False) -> None:
            """``form`` with a thing of each kind between its parts."""
            text, spans = form[0], []
            for kind, rest in zip(kinds, form[1:]):
                what, skip = made(kind, alone)
                spans.append((len(text) + skip, len(text) + len(what), kind))
                text += what + rest
            add(text, tuple(spans))

        if self.r.random() < 0.7:
            add(line())
        for _ in range(self.r.choice((1, 1, 2))):
            roll = self.r.random()
            kind = self.r.choice(KINDS)
            if roll < 0.26:
                put(self.r.choice(CARRIERS[kind]).split("{}"), [kind])
            elif roll < 0.36:
                named = self.r.choice(LABELS[kind].split("|"))
                put([named + self.r.choice(BETWEEN), self.r.choice(("", "", ", ok", '"', ";"))], [kind], alone=True)
            elif roll < 0.5:  # in the middle of an ordinary line
                words = line().split(" ")
                at = self.r.randrange(len(words) + 1)
                put([" ".join(words[:at]) + " " * (at > 0), " " * (at < len(words)) + " ".join(words[at:])], [kind])
            elif roll < 0.53:
                put(["", ""], [kind])
            elif roll < 0.55:
                ended = self.r.choice(CLOSINGS.split("|")) + self.r.choice((",\n", "\n", ", ", "!\n", " "))
                if self.r.random() < 0.5:
                    put([ended, ""], ["person"])
                else:
                    add(ended + self.fill(self.r.choice(NOBODY)))
            elif roll < 0.59:
                before, after = self.foreign(0, 3), self.foreign(0, 4)
                put([(before[:1].upper() + before[1:] + self.r.choice((" ", " ", ": "))) * bool(before), self.r.choice((" ", " ", ", ")) * bool(after) + after + self.r.choice((".", ""))], [kind])
            elif roll < 0.64:
                form = self.r.choice(TOGETHER)
                put(re.split(r"\{\w+\}", form), re.findall(r"\{(\w+)\}", form), alone=True)
            elif roll < 0.72:
                add(self.r.choice(CARRIERS[kind]).replace("{}", self.fill(self.r.choice(NOBODY))))
            elif roll < 0.75:
                add(self.r.choice(LABELS[kind].split("|")) + self.r.choice(BETWEEN) + self.fill(self.r.choice(NOBODY)))
            elif roll < 0.79:
                add(self.counted() if self.r.random() < 0.7 else self.paved())
            elif roll < 0.81:
                words = self.foreign(2, 7)
                add(words[:1].upper() + words[1:] + self.r.choice((".", "", ":", ",", f" {self.digits(3)}")))
            elif roll < 0.88:  # a look-alike in the middle of an ordinary line
                words = line().split(" ")
                at = self.r.randrange(len(words) + 1)
                add(" ".join([*words[:at], self.fill(self.r.choice(LOOKALIKES)), *words[at:]]))
            else:
                add(self.fill(self.r.choice(LOOKALIKES)))
            if self.r.random() < 0.5:
                add(line())
        return "".join(parts), gold


def lattice(text: str, gold: list[tuple[int, int, str]], model: Model) -> Iterator:
    """(window, indices of the right segments) of each window; windows whose right segments are no candidates are told by None."""
    for a, z in windows(text, model):
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while z < len(text) and not text[z].isspace():
            z += 1
        window = Window(text[a:z], model)
        where = {(window.spans[i][0] + a, window.spans[j - 1][1] + a, kind): k for k, (i, j, kind, _) in enumerate(window.segments)}
        mine = [g for g in gold if a <= g[0] and g[1] <= z]
        yield window, [where.get(g) for g in mine], mine


def gradient(window: Window, right: list[int], weights: dict[str, float]) -> tuple[float, dict[str, float]]:
    """Negative log-likelihood and its gradient of the right division, by forward and backward sums over segments and the kind last found."""
    n, segments, model = len(window.tokens), window.segments, window.model
    model.learn_moves()
    moves, states = model.moves, range(len(KINDS) + 1)
    scores = [sum(weights.get(f, 0.0) for f in s[3]) for s in segments]
    by_end, by_start = {}, {}
    for k, (i, j, _, _) in enumerate(segments):
        by_end.setdefault(j, []).append(k)
        by_start.setdefault(i, []).append(k)
    low = float("-inf")

    def add(values: list[float]) -> float:
        top = max(values)
        return top if top == low else top + math.log(sum(math.exp(v - top) for v in values))

    forward = [[0.0] + [low] * len(KINDS)]
    for j in range(1, n + 1):
        row = forward[j - 1]
        if j in by_end:
            more = [[v] for v in row]
            for k in by_end[j]:
                i, _, kind, _ = segments[k]
                at = KIND_NUMBER[kind]
                more[at].append(scores[k] + add([forward[i][s] + moves[s][at] for s in states]))
            row = [add(v) for v in more]
        forward.append(row)
    backward = [None] * n + [[0.0] * len(states)]
    for i in range(n - 1, -1, -1):
        row = backward[i + 1]
        if i in by_start:
            more = [[v] for v in row]
            for k in by_start[i]:
                at = KIND_NUMBER[segments[k][2]]
                after = scores[k] + backward[segments[k][1]][at]
                for s in states:
                    more[s].append(after + moves[s][at])
            row = [add(v) for v in more]
        backward[i] = row
    total, grad = add(forward[n]), {}
    names = ("none", *KINDS)
    for k, (i, j, kind, features) in enumerate(segments):
        at = KIND_NUMBER[kind]
        p = 0.0
        for s in states:
            value = forward[i][s]
            if value > low:
                q = math.exp(value + moves[s][at] + scores[k] + backward[j][at] - total)
                p += q
                if q > 1e-4:
                    move = f"move:{names[s]}>{kind}"
                    grad[move] = grad.get(move, 0.0) + q
        p -= k in right
        if abs(p) > 1e-4:
            for f in features:
                grad[f] = grad.get(f, 0.0) + p
    chosen, before = 0.0, 0
    for k in sorted(right, key=lambda k: segments[k][0]):
        at = KIND_NUMBER[segments[k][2]]
        chosen += scores[k] + moves[before][at]
        move = f"move:{names[before]}>{segments[k][2]}"
        grad[move] = grad.get(move, 0.0) - 1
        before = at
    return total - chosen, grad


def background(folder: str) -> tuple[list[str], set[str], list[str], list[str]]:
    """Ordinary lines of the documents, their words, and some nouns and adjectives for look-alikes."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    lines = [x.strip() for t in texts for x in re.split(r"\n+|(?<=[a-z0-9][.?!]) (?=[A-ZÄÖÜ¿É])", t) if 8 < len(x.strip()) < 300]
    lines = lines[:: max(1, len(lines) // LINES)]
    count: Counter[str] = Counter()
    for x in lines:
        count.update(set(w.lower() for w in re.findall(r"(?<![\w/.@-])[^\W\d_]+(?:['’][^\W\d_]+)*(?![\w/@])", x)))
    least = max(3, len(lines) // 1700)  # names, however often some come back, are rarer than ordinary words
    common = {w for w, n in count.items() if n >= least and w not in GIVEN and w not in TITLES}
    forms = [*(f for kind in CARRIERS.values() for f in kind), *(f for kind in LABELS.values() for f in kind.split("|")), *CLOSINGS.split("|"), *COUNTED.split("|"), *LOOKALIKES, *NOBODY]
    common |= {p.lower() for f in forms for p in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", re.sub(r"\{\w*\}", " ", f))} - GIVEN - TITLES
    probe = Model({}, common)
    plain = [x for x in lines if not list(windows(x, probe))]
    words = sorted(w for w in common if w.isascii() and len(w) > 3)
    return plain, common, words[::3], words[1::3]


def train(folder: str, seed: int = 11, examples: int = EXAMPLES, epochs: int = EPOCHS) -> dict:
    lines, common, nouns, adjectives = background(folder)
    weights: dict[str, float] = {}
    model = Model(weights, common)
    make = Invent(seed, nouns, adjectives)
    data, lost = [], Counter()
    for _ in range(examples):
        text, gold = make.example(lambda: make.r.choice(lines))
        for window, right, mine in lattice(text, gold, model):
            for g, k in zip(mine, right):
                if k is None:
                    lost[g[2]] += 1
            if None not in right:
                data.append((window, right))
    print(len(lines), "lines", len(common), "words", len(data), "windows, no candidate:", dict(lost))
    often = Counter(f for window, _ in data for _, _, _, features in window.segments for f in features)
    for window, _ in data:
        window.segments = [(i, j, kind, [f for f in features if often[f] > 3]) for i, j, kind, features in window.segments]
    squares: dict[str, float] = {}
    order = random.Random(seed)
    mean: Counter[str] = Counter()
    for epoch in range(epochs):
        order.shuffle(data)
        loss = 0.0
        for window, right in data:
            nll, grad = gradient(window, right, weights)
            loss += nll
            for f, g in grad.items():
                g += L2 * weights.get(f, 0.0)
                squares[f] = squares.get(f, 0.0) + g * g
                weights[f] = weights.get(f, 0.0) - RATE * g / (math.sqrt(squares[f]) + 1e-3)
        if epoch:  # the mean over epochs is steadier than the last one
            for f, w in weights.items():
                mean[f] += w / (epochs - 1)
        print("epoch", epoch, "loss", round(loss / len(data), 4))
    kept = {f: round(w, 2) for f, w in sorted(mean.items()) if abs(w) >= 0.1}
    return {"weights": kept, "common": sorted(common)}


if __name__ == "__main__":
    made = train(sys.argv[1])
    MODEL.write_text(json.dumps(made, ensure_ascii=False, separators=(",", ":")))
    print(len(made["weights"]), "weights", MODEL.stat().st_size, "bytes")
