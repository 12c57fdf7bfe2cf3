"""Lines about invented persons in frames that the training examples don't have, and lines without personal data.

Written by hand. A frame's slots are filled from the lists below, three times each.
"""

import re

VALUES = {
    "name": [
        "Grace Hopper", "Nathan Lane", "Kim West", "Oliver North", "Emily Johnson", "Robert Downey", "Mohammed Al-Farsi", "O'Brien, Patrick", "John Fitzgerald Kennedy", "Maria da Silva", "Ingrid Bergqvist", "Paolo Verdini",
        "J. Ashworth", "Mary Ann Thornbury", "Grace Tillman", "Lefebvre, Antoine", "Zoltán Kerekes", "Aoife Brennan", "Dimitra Alexiou", "Tomasz Wróblewski", "Yuki Matsuda", "Ravi Chandrasekar", "Thandi Nkosi", "Elif Aksoy", "Hugo van den Heuvel",
        "Søren Mikkelsen", "Carla M. Benítez", "LAURA STEINHAUS", "Pham, Linh", "R. K. Prasad", "Fiona MacAllister", "Gustavo Teixeira", "Beatrice Lombardo", "Grace Okonkwo", "Wolfgang Petzold", "Chiara Santangelo", "Liisa Rantanen", "Ana Kovač", "Samuel Adeyemi", "Noor Haddadi",
    ],
    "email": [
        "michael_smith92@yahoo.co.uk", "grace.hopper@navy.example", "p.verdini@studio-verdini.it", "kwest@uni-graz.at", "tomasz.wroblewski@poczta.pl", "ravi.chandrasekar+lists@gmail.com", "lombardo.b@ospedale.it", "fiona-macallister@skye.scot", "thandi@nkosi.co.za", "l.rantanen@posti.fi",
        "zoltan [at] kerekes [dot] hu", "yuki.matsuda (at) example.jp", "aoife at brennan dot ie", "samuel.adeyemi[at]mail.ng", "hugo.heuvel@heuvel-fietsen.nl", "elif.aksoy@posta.com.tr", "wpetzold@t-online.de", "noor_h@hotmail.com", "carla.benitez@correo.mx", "Antoine.Lefebvre@laposte.net",
    ],
    "phone": [
        "+1 212-867-5309", "(415) 238-9911", "+44 20 7946 0812", "0161 496 0735", "+49 89 4417 2231", "+33 6 12 34 56 78", "01 42 68 53 00", "+39 02 4801 7723", "+34 612 34 90 17", "+31 6 2488 1907", "+46 70 173 06 22", "+48 601 234 987", "+91 98201 44576", "+81 3-5412-8890", "(11) 3871-2245",
        "+55 21 99871-4402", "020 7946 0321", "312.664.9087", "0172/4418902", "+61 412 907 335", "+353 87 221 9045", "+358 40 5512890", "206-441-8832", "+27 82 554 1903",
    ],
    "national_id": [
        "078-05-1120", "219-09-9999", "AB 12 34 56 C", "JG103759A", "RSSMRA85T10A562S", "bnclra72c41h501v", "12345678Z", "X1234567L", "123.456.789-09", "850709-9805", "1 85 05 78 006 084 36", "ABCDE1234F", "311280-888Y", "756.1234.5678.97", "HEGG560427MVZRRL04", "010180-1234567", "20-12345678-3", "85.07.30-033.28", "070761-4285",
        "457-55-5462",
    ],
    "street": [
        "742 Evergreen Terrace", "22 Baker Street, Flat 3", "Rua das Flores 45", "Calle de Alcalá 211", "Via Garibaldi 18", "Hauptstraße 12", "14 rue de Rivoli", "Prinsengracht 263", "Storgatan 7", "ul. Marszałkowska 104", "1600 Amphitheatre Parkway", "31 Spooner Street", "9 Castle Hill Road", "Lindenallee 42a", "221B Harley Street",
        "Avenida Paulista 1578", "8 Mill Lane", "410 Terry Avenue, Suite 200", "67 boulevard Voltaire", "Piazza Dante, 3",
    ],
}

FRAMES = [
    "git blame shows that {name} touched this in 2014", "Our plumber, {name}, can be reached under {phone}.", "The parcel went to {street} instead of the depot", "<td>{name}</td><td>{street}</td>", "cn={name},ou=people,dc=corp", "lead: {name} (since March), deputy: {name}",
    "new Person(\"{name}\", \"{phone}\", null)", "Hi {name}, can you look into this before Friday?", "{name} is on holiday, so ask {name}", "user {email} exceeded the quota", "bounce: {email} mailbox full", "Subject: visit of {name} on Tuesday", "ring {phone} and let it ring twice",
    "gate code is 4411, buzzer {name}", "rows 3 to 9 were typed in by {name}", "{name} - {email} - {phone}", "employee #221 {name} {national_id}", "his SSN is {national_id}, keep it out of the logs", "NI {national_id} was rejected by the parser", "{name},{national_id},{street},true", "\"who\": \"{name}\", \"where\": \"{street}\"",
    "tenant {name} moved into {street} in May", "photo by {name}", "slides: {name}, Lisbon 2019", "// ask {name} why this is needed", "# idea stolen from {name}", "/* workaround until {name} is back */", "-- backfilled for {name} on request", "<!-- {name} wants this removed -->", "thanks {name} for spotting the leak",
    "approver={name};backup={name}", "notify('{email}', level=3)", "send_sms(\"{phone}\", \"hi\")", "lookup_tax_number('{national_id}')", "geocode(\"{street}\")", "driver: {name} / plate: KX 221", "Interviewer: {name}    Candidate: {name}", "emergency contact {name} {phone}", "call me any time, {phone}", "my number changed to {phone} last week",
    "the shop at {street} closes at six", "he lives in {street}, second floor", "come to {street} by noon", "invoice to {name}, {street}", "{name} <{email}> wrote:", "> {name} wrote on Monday:", "Sincerely, {name}", "Best regards {name}", "yours, {name}, {phone}", "P.S. {name} says hello",
    "passport holder: {name}; number {national_id}", "kid.setGuardian(\"{name}\");", "let owner = '{name}';", "const CEO = \"{name}\";", "authors = [\"{name} <{email}>\"]", "maintainers:  {name}, {name}", "t.Errorf(\"want %s\", \"{name}\")", "expect(page).toContain('{name}')", "EXPECT_EQ(p.phone(), \"{phone}\");", "assert tax_ok(\"{national_id}\")",
    "'{street}' is the default address", "home: '{street}',", "fax '{phone}' bounced twice", "mail bounced for {email}", "{email} unsubscribed", "forwarded to {email} by mistake", "please write to {email} or call {phone}", "email {email} for the password", "login failed for {email} from 10.2.3.4", "cc'd {email} and {email}",
    "in memory of {name}", "dedicated to {name}", "advisor: {name}", "Patient {name}, born 1961, id {national_id}", "nurse {name} signed the form", "Dr. {name} prescribed it", "Mrs {name} paid in cash", "witnessed by {name} and {name}", "sold to {name} for 300", "rented from {name}, {street}",
    "the account of {name} was merged with that of {name}", "{name}: fixed the build", "{name} reviewed 14 patches", "merge request by {name}", "first reported by {name} in 2011", "see the talk of {name} at the conference", "{name} and {name} paired on this", "| {name} | {phone} | 14 |", "| {street} | {name} |", "{phone}\t{name}\t{email}",
    "{national_id}\t{name}", "id={national_id}&ok=1", "\"{national_id}\" belongs to {name}", "document {national_id} expired", "tax code {national_id} (checked)", "personal number: {national_id}", "social security {national_id}", "delivery address {street}", "site visit: {street}", "meet at {street}, ring at {name}",
]

NOTHING = [
    "Grace Period of 30 days", "the Rolling Window is kept", "Kubernetes Pod restarts 12 times", "Random Forest beats Linear Regression", "see Table 12, Section 3", "ISBN 978-3-16-148410-0", "order 4471-2290-8831 shipped", "IBAN DE89 3704 0044 0532 0130 00", "ip 192.168.14.200 is blocked", "released on 2023-04-17", "Mozilla Public License 2.0",
    "Copyright 2019 The Verdini Corporation", "University of Graz", "Acme Holdings Ltd", "send it to support@acme.example", "noreply@acme.example", "git@git.acme.example:tools/core.git", "version 10.4.221 of the client", "error 500 in Module Loader", "New York and Los Angeles", "Monday Morning Report", "SELECT Name FROM Users WHERE Id > 4000", "GROUP BY ALL",
    "sha256 9f86d081884c7d659a2feaa0c55ad015", "PUBLIC KEY BLOCK", "Main Street Theme", "uuid 3f2504e0-4f89-11d3-9a0c-0305e82c3301", "timeout = 30000 ms", "x = 3.14159265 * r", "part 55-1023-77", "4 lanes, 2 roads", "Creative Commons Attribution", "Part No. 881-22-90017", "GMT+01:00 Berlin", "The Quick Brown Fox",
    "Thread Pool Executor", "case 7: return Left Right", "1 234 567 rows read", "epoch 1672531200", "Boston Marathon 2022", "import java.util.List", "Step 4 Of 9", "lat 48.8566, lon 2.3522", "10.1109/5.771073", "postgres://app:s3cret@db.acme.example/main", "user@1.2.3", "Golden Gate Bridge", "Lake Como", "Microsoft Windows Server", "Visual Studio Code",
]


def labelled() -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(line, spans) of all frames, each filled three times, with the next values of each list."""
    at = dict.fromkeys(VALUES, 0)
    out = []
    for _ in range(3):
        for frame in FRAMES:
            text, found = "", []
            for piece in re.split(r"(\{\w+\})", frame):
                kind = piece[1:-1]
                if piece[:1] == "{" and kind in VALUES:
                    value = VALUES[kind][at[kind] % len(VALUES[kind])]
                    at[kind] += 1
                    found.append((len(text), len(text) + len(value), kind))
                    text += value
                else:
                    text += piece
            out.append((text, found))
    return out
