"""A small labelled table of lines with and without personal data, in everyday phrases of several languages, with invented people and places."""

from __future__ import annotations

import random
import unicodedata

KINDS = ("email", "phone", "id_number", "address", "name")

#: Slots of the lines: {N} name, {E} e-mail, {P} phone, {Q} phone of a form that tells it, {I} identity number, {A} address. Unlabelled: {F} family name,
#: {G} given name, {L} initial, {S} street without number, {C} town, {M} coined term, {T} title, {Y} year, {D} small number,
#: {D1} digit, {R2} to {R9} digits, {H} hexadecimal digits, {W} words, {K} capitalised words, {V} a word that begins a sentence, {B} a German noun, {UP} capitals, {CJK} characters.
ENGLISH = (
    "Hi, this is {N} speaking.", "{V} {W} {N} {W}.", "{W} {N} {W}.", "{W} {N}.", "{W} {N}, {W}.", "{V} {N} {W} {N} {W}.", "{W}, {N}, {W}.", "{N} {W}.", "{N} {W} {N}.", "{N}, {W}, {W}.", "{W} {W}: {N}.", "{W} of {N} {W}.", "{W} to {N} {W}.", "{W} for {N}: {W}.", "{W} with {N} and {N}.", "{V} {W} by {N}, {W} by {N}.", "the {W}, {N}, {W}.", "{T} {N} {W}.", "Yours, {N}", "{V} {W}: {N}, {W}; {N}, {W}.", "Hello {N},", "Dear {T} {N},", "Kind regards,\n{N}", "Best wishes,\n{N}\n{E}", "Yours sincerely,\n{N}\n{A}", "Sent by {N} on Tuesday.", "From: {N} <{E}>", "To: {N} <{E}>, {N} <{E}>", "Cc: {E}, {E}", "contact {N} at {E}", "reach {N} on {P} or at {E}", "{N} at {E}", "{V} {W} {N} at {P} {W}.",
    "Name: {N}\nAddress: {A}\nTelephone: {P}\nE-mail: {E}", "Full name: {N}", "Author: {N}", "Editor: {N}", "Edited by {N} and {N}.", "Written by {N}, {W}.", "Photo by {N}.", "{N} and {N} presented {W}.", "{N} told us that {W}.", "{N} said {W}.", "{N} wrote {W}.", "{N} thinks {W}.", "{N} noticed {W} and {N} agreed.",
    "Yesterday {N} and {N} met in {C}.", "According to {N}, {W}.", "I spoke with {N} about {W}.", "We met {N} in {C}.", "Thanks to {N} for {W}.", "Many thanks to {N}, {N} and {N}.", "Our colleague {N} left for {C}.", "It is {N} who {W}.", "Ask {N} or {N}.", "{T} {N} is our new director.", "{T} {N} will see you at {D}.", "the patient, {N}, {W}", "Witness {N} stated that {W}.", "This account belongs to {N}.", "Applicant {N} lives at {A}.",
    "{N}, {D}, of {C}, {W}.", "{W}, said {N}.", "{W} ({N})", "{W} - {N}", "{N}: {W}.", "{N}'s {W}", "{N} ({E})", "{N}, {E}", "{N}\n{A}", "{N} / {P}", "{N}; {N}; {N}", "Attendees: {N}, {N}, {N}", "Present: {N}, {N}.", "Emergency contact: {N}, {P}", "Next of kin: {N}, {A}, {P}", "Supervisor: {T} {N}", "Please ask for {N} at the desk.",
    "Call me on {P}.", "You can ring {P} any time.", "Phone {P} or fax {P}.", "Mobile: {P}", "Tel. {P}", "Tel: {P}", "T {P} | E {E}", "My cell is {P}, {W}.", "Text {P} for {W}.", "Dial {P}, extension {D}.", "{W}, {Q}, {W}.", "{W} {Q} {W}.", "{W}: {Q}", "{W} {Q}.", "{W} {E} {W}", "{W} {E} {W}.", "{E} {W}", "{W}\n{E}", "{W}, {E}, {W}", "{K} - {N} - {Q}", "Chair - {N} - {E}", "Secretary - {N}", "Manager - {N} - {P}", "{C} - {N} - {P}", "Owner - {N}, {P}", "Treasurer - {N} - {A}", "{K} - {N}", "{K}: {N}; {K}: {N}", "{N} {A}", "{I}, {A}", "{W} {A}, {W}", "{W} {A}.", "{W}: {A}", "{A} ({W})", "{W}\n{A}\n{W}", "phone {P}", "telephone number {P}", "number {P}", "tel {P}", "fax: {P}", "call {P} or {P}", "{W} by phone ({P})", "{W} at {P} or {E}", "{W} on {P}, {W}.", "{N} - {P}", "{N}, tel. {P}, {E}", "{N} ({P})", "reach us at {P} (ext. {D})", "Our office number is {P}.", "Hotline: {P} (weekdays {D}-{D1})", "WhatsApp {P}", "{Q} ({W})",
    "Mail {E} with {W}.", "My address is {E}.", "Drop a line to {E}.", "E-mail: {E}", "{E} or {E}", "<{E}>", "({E})", "mailto:{E}", "Send your CV to {E}.", "{W}: {E}", "{W} from {E} {W}", "write to us: {E}.", "contact {E}", "unsubscribe {E}", "account {E} was locked", "user {E} logged in", "{V} {E} {W}.", "{V} {E} {W}", "{W}. {V} {E} {W}.", "{V} {N} {W}.", "{V} {N}, {W}.", "{N} ({E}, tel. {P})", "({E}; tel. {P})", "{W} ({P}; {E})", "tel. {P}; {W}", "{V} {P} {W}.", "tel. {P}. {V} {W}.", "{N} | {P} | {E}", "{V} {A}, {W}.", "[mail](mailto:{E})", "login={E}&id={D}",
    "SSN: {I}", "His social security number is {I}.", "the SSN on file was {I}", "Social Security No. {I}, {W}", "Passport number: {I}", "passport {I} expires in {Y}", "holder of passport {I}", "identity number {I}", "identification number: {I}", "national identity no. {I}", "tax identification number {I}", "taxpayer {I}", "social security {I}", "{W} SSN {I} {W}.", "ID: {I}", "ID: {I} {W}", "ID: {I}; {N}", "{W}. ID: {I}", "identity no. {I}", "passport no. {I}", "{W} passport no. {I} {W}.", "the number of her passport, {I}, {W}", "identity number {I} {W}", "citizen number {I}", "personal identity number: {I}", "insurance number: {I}", "number of the ID card: {I}", "identity number: {I} ({W})", "numéro {I} de la carte d'identité", "tax number: {I} {W}", "ID number: {I}", "passport number: {I} {W}", "{W} national identity {I}", "staff ID: {I}", "licence no. {I}", "Driver's licence: {I}", "{W} driver's licence {I} {W}", "tax no. {I}", "social security number: {I}, {W}", "card number of the identity card: {I}", "{W} (SSN {I}), {W}.", "{W} passport {I}, {W}", "{W} tax ID {I} {W}", "{W} identity card {I} {W}", "{W} licence number {I} {W}", "{W} staff ID {I} {W}", "{W} ID: {I}, {W}", "{N}; ID: {I}; {P}", "ID {I}, phone {P}", "SSN {I} phone {P}", "Passport No {I}, issued in {C}", "National ID {I}", "ID card number {I}", "ID no. {I}", "ID {I}", "identity card {I}", "Tax ID: {I}", "Her tax number is {I}.", "TIN {I}", "National Insurance number {I}", "NI number: {I}", "Driver license: {I}", "driving licence number {I}", "licence {I}, {W}", "Employee ID {I}", "staff number {I}", "staff no. {I}", "personnel number {I}", "member of staff {I}", "badge {I} belongs to {N}",
    "{N}, passport {I}", "{N} (ID {I})", "{N} ({I})", "Mr and Mrs {F}, {A}", "I live at {A}.", "Our office is at {A}.", "Ship to: {A}", "Mailing address: {A}", "Billing address:\n{A}", "Return to {N}, {A}.", "Visit us: {A}", "moved to {A} in {Y}", "The house at {A} was sold.", "Send it to {A}, {W}.", "{A}", "{A}\n{P}", "Letters may be addressed to {A}.", "Head office: {A}, phone {P}", "{W} {A} {W}.",
    "name,phone,email\n{N},{P},{E}", "| {N} | {E} | {P} |", "| {W} | {N} | {I} |", '{{"name": "{N}", "email": "{E}", "phone": "{P}"}}', '{{"id": "{D}", "owner": "{N}", "address": "{A}"}}', "name: {N}\nphone: {P}\n", "# author: {N} <{E}>", "// {N} {W}", "{W}\n\n{N}\n{P}\n{E}\n", "--\n{N}\n{K}\n{A}\n{P}\n{E}", "Regards\n{N}\n{A}\n{P}", "P.S. {N} {W}.", "on behalf of {N}", "{N} et al.'s {W}", "by {N}, {Y}", "{W} by {N} {W}", "To whom it may concern: {N} {W}.", "{N} was born in {C} in {Y}.",
)
GERMAN = (
    "Es {W} {N} {W}.", "Die {W} {W} {N}, {W}.", "Gestern {W} {N} {W}.", "Wenden Sie sich an {N}.", "{W} hat {N} {W}.", "Guten Tag {N},", "Sehr geehrte Frau {N},", "Sehr geehrter Herr {T} {N},", "Mit freundlichen Grüßen\n{N}", "Viele Grüße, {N}", "Mein Name ist {N}.", "Ich heiße {N} und wohne in {C}.", "Laut {N} ist {W}.", "{N} und {N} haben {W}.", "{N} sagte, {W}.", "Unser Kollege {N} {W}.", "Herr {N} ist heute nicht da.", "Frau {T} {N} leitet {W}.", "Bitte rufen Sie {N} unter {P} an.", "Telefon: {P}", "Tel.: {P}, Fax: {P}", "Handy {P}", "Meine Nummer ist {P}.", "Sie erreichen uns unter {P}.", "E-Mail: {E}", "Schreiben Sie an {E}.", "Mail an {E} genügt.",
    "Name: {N}\nAnschrift: {A}", "Wohnhaft in {A}.", "Adresse: {A}", "Unser Büro: {A}", "Bitte senden an {N}, {A}.", "Er wohnt {A}.", "Personalausweis Nr. {I}", "Ausweis {I}", "Ausweisnr.: {I}", "Reisepass {I}, gültig bis {Y}", "Passnummer {I}", "Steuernummer: {I}", "Steuer-Identifikationsnummer {I}", "Seine Sozialversicherungsnummer lautet {I}.", "Führerschein {I}", "Personalnummer {I}", "Mitarbeiter {N}, Nr. {I}", "Kontakt: {N}, {E}", "Verfasser: {N}", "{N}, {A}, Tel. {P}",
)
ROMANCE = (
    "Bonjour {N},", "Cordialement,\n{N}", "Je m'appelle {N}.", "Selon {N}, {W}.", "{N} et {N} ont {W}.", "Monsieur {N} est absent.", "Madame {N}, directrice, {W}.", "Mme {N} a {W}.", "M. {N} travaille à {C}.", "Notre collègue {N} {W}.", "Téléphone : {P}", "Tél. {P}", "Appelez-moi au {P}.", "Portable : {P}", "Joignable au {P}.", "Courriel : {E}", "Mon adresse est {E}.", "Adresse : {A}", "J'habite {A}.", "Nos bureaux : {A}", "domicilié {A}", "À envoyer à {N}, {A}.", "Passeport n° {I}", "Passeport : {I}", "Carte nationale d'identité {I}", "CNI {I}", "N° de sécurité sociale : {I}", "sécurité sociale {I}", "numéro fiscal {I}", "Permis de conduire {I}", "Matricule {I}", "Nom : {N}\nTél : {P}\nMél : {E}", "Auteur : {N}", "Signé : {N}, {A}",
    "Le {W}, {N}, {W}.", "{V} {N} {W}.", "de {N} {W}", "{W} à {N} {W}.", "La {W} de {N} {W}.", "Ha {W} {N} {W}.", "Hola {N}:", "Me llamo {N}.", "Según {N}, {W}.", "{N} y {N} {W}.", "El señor {N} vive en {A}.", "La doctora {N} {W}.", "Teléfono: {P}", "Llámame al {P}.", "Correo: {E}", "Dirección: {A}", "DNI {I}", "Pasaporte {I}", "Un saludo, {N}", "Ciao {N},", "Mi chiamo {N}.", "Secondo {N}, {W}.", "{N} e {N} {W}.", "Telefono: {P}", "Indirizzo: {A}", "Codice fiscale {I}", "Passaporto {I}", "La dottoressa {N} {W}.", "O senhor {N} mora em {A}.", "Meu nome é {N}.", "Telefone {P}", "Beste {N},", "Met vriendelijke groet, {N}", "Volgens {N} {W}.", "Telefoon {P}", "Adres: {A}", "Paspoort {I}",
)
CHINESE = ("我叫{N}。", "姓名：{N}", "{N} 说{CJK}。", "手机：{P}", "请拨打 {P}。", "请致电{P}，{CJK}。", "电邮：{E}", "请发送至 {E}。", "邮件{E}，{CJK}。", "住址：{A}", "身份证号：{I}", "证件号{I}", "护照 {I}", "护照号码：{I}，{CJK}", "{CJK}，{N} {CJK}。", "收件人：{N}，{A}", "{CJK}（{N}，{E}）", "联系 {N}（{P}）")
#: Nothing personal.
PLAIN = (
    "{B} von {M} {W}", "{B} aus der {B}", "die {B} der {B} {W}", "Im {B} {W}", "Im {B} zu {M} {W}", "{V} {B} von {M} um {D}.{D1} {B}", "{W} {B} weder {M} noch die {B}", "{B} und {B} {W}", "eine {B} {W} {B}", "Der {B} {W} die {B} {W}.", "Das {B} {W}.", "Den {B} {W} {B}.", "{B}, {B} und {B}", "{B} {D}: {B} von {M} und {M}", "{W} {B} {W} {B} {W}. {B} {W}.", "Die {B} {W}, die {B} {W} {M} {W}.",
    "| {K} | {K} | {K} |", "{K} | {K}", "{V} | {M} | {D}", "{K}\n\n{V} {W} {W}.", "{K}\n{V} {W}.", "{K}\n\n{M} {W}.", "{K}\n\n{K}\n\n{W}", "{M}. {V} {W}.", "{W} {M}. {V} {W} {W}.", "{M}-{L}. {V} {W}.", "{V}, {M} {W}.", "{V} von {M}", "{W} de {M}", "{M} da {C}", "{C}, {C} {W}", "{C} and {C} {W}", "{C} {W} {C}.", "{UP} {D} {UP}", "{UP}\n\n{UP}. {W}", "{UP}. {UP} {M} {UP}.", "{V} {UP} {W}", "La {K} da {C}", "{V} {W} da {C}",
    "{V} {M}'s {W}", "{V} {W}, {M} {W}.",
    "{V} {M} {W}.", "{V} {M}, {W}.", "{V} {M} and {M}, {W}.", "{V} {W} {M} {W}.", "{V} {W} {M}, {W} {M}.", "{V} the {K} {W}.", "{V} {K} {W}.", "{V} {C}, {W}.", "{W}. {V} {M} {W}.", "{W}. {V} {M}: {W}.", "{V} {M}", "{V} {M} {W}? {V} {M} {W}.", "{W} {M} {W} {M} {W}", "{K} {M}", "{M} {K}", "the {M} {W}", "{W} {K} {W} {K} {W}.", "{K} {K} {W}", "{V} {F} and {F} {W}.", "{V} {F} ({Y}) {W}.",
    "{R3}-{R4}-{R4}", "sizes {R3}-{R3}-{R4} {W}", "{W} layers {R3}-{R3}-{R4}", "units: {R3}-{R3}-{R4}", "layer widths {R4}-{R4}-{R4} {W}", "dimensions of {R3}-{R4}-{R4} and {R2}-{R3}-{R3}", "{R3}-{R3}-{R3} split {W}", "hidden sizes {R3}-{R3}-{R4}", "{W} {R4}-{R4}-{R4} {W}", "{R3} {R3} {R4} {W}", "{W} {R3} {R3} {R4} {W}", "{W}: {R3} {R2} {R4}", "{R2} {R2} {R2} {R2} {W}", "{R2} {R3} {R3} {R3} {W}", "{W} {R3}, {R3}, {R4} {W}", "{R3} {R2} {R4}\n{R3} {R2} {R4}", "sums {R3} {R4} {R4}", "{W} {R9} {W}", "{W} {R3}{R8} {W}", "part no. {L}{L}-{R6}-{D1}", "grant {R3}-{R2}-{R4}", "award {R3}-{R2}-{R4} {W}", "contract number {R3}-{R2}-{R4}", "account {R3}-{R2}-{R4}", "reference {R3}-{R2}-{R4}", "project {R3}-{R2}-{R4} {W}", "case no. {R3}-{R2}-{R4}", "{W} {R3}-{R2}-{R4} {W}", "order no. {R4}-{R4}-{R2}", "grant {R4}-{R4}-{R2}", "model {L}{R8}", "{W} {L}{R7} {W}", "serial {L}{L}{R7}", "batch {L}{L}-{R6}", "barcode {R3}{R9}",
    "{K} is {W}.", "The {K} {W}.", "{K}\n\n{W}", "{D}. {K}", "{D}.{D1} {K}\n{W}", "# {K}", "## {K}\n\n{W}.", "{K}: {W}.", "In {C}, {W}.", "from {C} to {C}", "The University of {C} {W}.", "{C} University Press", "Institute of {K}, {C}", "the {F} Institute in {C}", "Department of {K}", "{K} Conference, {C}, {Y}", "On Monday, {D} March {Y}, {W}.", "{Y}-{R2}-{R2} {R2}:{R2}:{R2}", "{R2}/{R2}/{Y}", "between {Y} and {Y}", "{Y}–{Y}", "pp. {R2}-{R3}", "vol. {D}, no. {D1}, pp. {R3}–{R3}",
    "{F} ({Y}) {W}.", "{F} and {F} ({Y})", "({F}, {Y}; {F} et al., {Y})", "{F} et al. {W}", "as in {F} & {F} [{D}]", "[{D}] {L}. {F} and {L}. {F}. {K}. {Y}.", "{F}, {L}., {F}, {L}.: {K}. {K} {D} ({Y})", "{F}, {L}. {W}. {K}, {D}({D1}):{R3}–{R3}, {Y}.", "the {F} test", "{F}'s theorem {W}", "a {F} distribution", "the {F}-{F} algorithm", "Mr {F} and Mrs {F} {W}.", "{T} {F} {W}.", "{L}. {F} {W}.", "{G} said {W}.", "thanks, {G}",
    "{M} {W}.", "{M} and {M} {W}.", "{M} with {M} {W}", "the {M} {K}", "{M}-{D1} beats {M} by {D}.{D1} %", "We compare {M}, {M} and {M}.", "{K} of {M}", "{M} {D1}.{D1}.{D1}", "version {D1}.{D}.{D}", "v{D1}.{D1}.{R2}-beta", "pip install {W}=={D1}.{D}.{D1}", "def f(x, y={D}):\n    return x[{D1}]", "import {W}\nfor i in range({R3}):", "@{W}\n", "{W}@{D}", "P@{D} and MAP@{R3}", "https://www.{W}.org/{D}", "http://{C}.example/{W}?id={R4}", "10.{R4}/{W}.{Y}.{R5}", "doi:10.{R4}/{R6}", "arXiv:{R4}.{R5}", "ISBN {R3}-{D1}-{R5}-{R3}-{D1}", "ISSN {R4}-{R4}", "order {R8}", "invoice no. {R6}", "case {R5}/{Y}", "grant {L}{L}-{R7}", "project number {R6}", "ticket {R5}", "issue #{R4}", "commit {H}", "sha {H}{H}", "seed {R5}", "{R2}.{R2}.{R3}.{D1}", "{R3} x {R3}", "{R3}-{R3}-{R3} units", "{R2},{R3},{R3} tokens", "{D},{R3} {W}", "{D}.{R2} {D}.{R2} {D}.{R2} {D}.{R2}", "{R3} {R3} {R3} {R3}", "{R4} {W} {R4} {W}", "$ {D},{R3}.{R2}", "{R2} % of {R4}", "{D} of {D}", "p < 0.{R2}", "n = {R4}", "k={D}, b=0.{R2}", "page {D} of {R3}", "room {R3}", "Table {D1}: {K}", "Figure {D}. {W}", "Equation ({D}) {W}", "Section {D1}.{D1} {W}", "line {R3}, column {D}",
    "| {K} | {D}.{R2} | {D}.{R2} |", "| {M} | {R3} | {W} |\n| {M} | {R3} | {W} |", "|---|---|---|", "{UP}", "{UP} {UP}", "{UP}: {W}", "{UP} ({Y}) {UP}", "{W}, {W}; {W}.", "{W}? {W}! {W}.", '"{W}," {W}.', "{K}, {K} and {K}", "{K} / {K}", "- {W}\n- {W}\n- {W}", "* {K} {W}", "1. {W}\n2. {W}", "{W}\n{W}\n{W}", "{W} in {S} {W}", "{S} was closed.", "the corner of {S} and {S}", "{S}, {C}", "{C} {R5}", "{C}, {C} and {C}", "the river {C}", "{W} {R5} {W}", "{W} {Y} {W}", "the {D}th of May", "room {D}, floor {D1}", "flat {W}", "box {D} {W}", "number {D} {W}", "{D} {W} {D} {W}", "phone calls {W}", "the email {W}", "an address {W}", "the passport {W}", "identity {W}", "name {W}", "no name, no address, no phone", "call {M} {W}", "contact {W}", "by {W}", "tel {W}",
    "Die {K} von {M} {W}.", "In {C} gibt es {W}.", "{F} und {F} ({Y}) {W}.", "Nach {F} ({Y}) {W}.", "Abbildung {D}: {K}", "Der {M} ist {W}.", "um {D} Uhr", "{D}. Mai {Y}", "La {K} de {M} {W}.", "Les {W} de {C} {W}.", "D'après {F} et {F} ({Y}), {W}.", "le {D} mars {Y}", "La {W} y el {W}.", "{K} di {C}", "{CJK}。{CJK}，{CJK}。", "{CJK}{D}{CJK}。", "{CJK} {M} {CJK}", "{CJK}（{Y}）", "{W} {CJK}，{CJK}", "{CJK}：{CJK}。{CJK}{R4}{CJK}。",
)
LINES = (*ENGLISH, *GERMAN, *ROMANCE, *CHINESE)

WORDS = (
    "the", "a", "of", "and", "to", "in", "is", "was", "were", "that", "it", "with", "as", "for", "on", "are", "this", "by", "at", "from", "not", "but", "which", "their", "has", "have", "had", "we", "they", "our", "its", "more", "than", "two", "three", "all", "some", "when", "after", "before", "under", "over", "between", "because", "while",
    "time", "work", "day", "week", "letter", "letters", "report", "paper", "papers", "text", "page", "pages", "book", "note", "answer", "question", "result", "results", "method", "number", "list", "table", "figure", "data", "model", "search", "query", "index", "score", "scores", "test", "train", "error", "errors", "word", "words", "file", "files", "copy", "version", "system", "team", "office", "meeting", "library", "archive", "street", "house", "city", "name", "address", "phone", "record", "records", "sample", "review", "section", "document", "documents", "retrieval", "scan", "image",
    "found", "made", "sent", "gave", "took", "asked", "checked", "read", "wrote", "signed", "left", "called", "moved", "works", "shows", "needs", "became", "changed", "missing", "new", "old", "small", "large", "good", "better", "first", "last", "next", "same", "other", "many", "few", "each", "every", "long", "short", "early", "late", "open", "full", "clear", "very", "only", "also", "again", "here", "there", "then", "now",
    "der", "die", "das", "und", "ist", "nicht", "eine", "mit", "für", "auf", "wird", "le", "la", "les", "des", "est", "une", "dans", "pour", "sur", "avec", "el", "los", "una", "con", "per", "het", "een", "van",
)
NOUNS = ("Frage", "Antwort", "Seite", "Seiten", "Zeit", "Jahr", "Jahre", "Arbeit", "Stadt", "Haus", "Buch", "Bild", "Satz", "Wort", "Wörter", "Text", "Texte", "Zahl", "Punkte", "Prozent", "Teil", "Ende", "Anfang", "Beispiel", "Grund", "Ergebnis", "Ergebnisse", "Methode", "Modell", "Modelle", "Daten", "Fehler", "Suche", "Tabelle", "Abschnitt", "Preis", "Rede", "Schlüssel", "Leben", "Welt", "Land", "Weg", "Brief", "Bericht", "Sprache", "Vergleich", "Fälle", "Quelle", "Menge", "Probe")
OPENERS = ("Unlike", "Although", "Both", "However", "Moreover", "Given", "With", "Without", "For", "From", "Using", "While", "Whereas", "Since", "Thus", "Hence", "Then", "Does", "Can", "Did", "To", "In", "On", "At", "By", "Also", "Only", "Every", "Each", "Most", "Some", "Like", "Against", "Compared", "Following", "Overall", "Finally", "Conversely", "Meanwhile", "Similarly", "Instead", "Indeed", "Still", "Yet", "No", "Not", "All", "Any", "Such", "If", "When", "Where", "After", "Before", "Yesterday", "Today", "As", "An", "A", "The", "Hier", "Gestern", "Il", "Elle", "Nous", "Im", "Am", "Zur", "Bis", "Yours", "Dear", "First", "Second", "Next", "Here", "There", "This", "These", "Those", "It", "We", "Our", "Their", "Its", "Wie", "Wenn", "Mit", "Ohne", "Bei", "Eine", "Avec", "Sans", "Pour", "Dans", "Comme")
CHARACTERS = "的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经十三之进着等部度家电力里如水化高自二理起小物现实加量都两体制机当使点从业本去把性好应开它合还因由其些然前外天政四日那社义事平形相全表间样与关各重新线内数正心反你明看原又么利比或但质气第向道命此变条只没结解问意建月公无系军很情者最立代想已通并提直题党程展五果料象员革位入常文总次品式活设及管特件长求老头基资边流路级少图山统接知较将组见计别她手角期根论运农指几九区强放决西被干做必战先回则任取据处队南给色光门即保治北造百规热领七海口东导器压志世金增争济阶油思术极交受联认六共权收证改清己美再采转更单风切打白教速花带安场身车例真务具万每目至达走积示议声报斗完类八离华名确才科张信马节话米整空元况今集温传土许步群广石记需段研界拉林律叫且究观越织装影算低持音众书布复容儿须际商非验连断深难近矿千周委素技备半办青省列习响约支般史感劳便团往酸历市克何除消构府称太准精值号率族维划选标写存候毛亲快效斯院查江型眼王按格养易置派层片始却专状育厂京识适属圆包火住调满县局照参红细引听该铁价严龙飞"
GIVEN = (
    "Margaret", "Rajesh", "Eleanor", "Victor", "Jenny", "Priya", "Mohammed", "Fatima", "Carlos", "Lucia", "Giovanni", "Chiara", "Hans", "Ingrid", "Jürgen", "Sabine", "Pierre", "Camille", "Sophie", "Étienne", "Olga", "Dmitri", "Ivan", "Katarzyna", "Piotr", "Jan", "Pieter", "Anneke", "Lars", "Astrid", "Kwame", "Amara", "Chinedu", "Ngozi", "Yuki", "Hiroshi", "Wei", "Xiaoming", "Min-jun", "Seo-yeon", "Ahmed", "Layla", "Noor", "Omar", "Elif", "Mehmet", "João", "Beatriz", "Siobhán", "Liam", "William", "Thomas", "Emily", "Charlotte", "George", "Oliver", "Amelia", "Daniel", "Rachel", "Benjamin", "Hannah", "Samuel", "Grace", "Ravi", "Sunita", "Arjun", "Nguyen", "Thanh", "Linh", "Mateo", "Camila", "Diego", "Isabella", "Tomás", "Zoë", "Björn", "Søren", "Miguel", "Alejandra", "Francesca",
)
FAMILY = (
    "O'Connell", "Kumar", "Vance", "Hargreaves", "Lawson", "Patel", "Khan", "Hassan", "García", "Rodríguez", "Rossi", "Ferrari", "Müller", "Schmidt", "Schröder", "Becker", "Dubois", "Lefèvre", "Moreau", "Petrov", "Ivanova", "Kowalski", "Nowak", "de Vries", "van den Berg", "Jansen", "Andersson", "Johansen", "Mensah", "Okafor", "Adeyemi", "Tanaka", "Suzuki", "Wang", "Zhang", "Kim", "Park", "Al-Farsi", "Haddad", "Yılmaz", "Demir", "Silva", "Santos", "Murphy", "O'Brien", "MacDonald", "McCarthy", "Smith", "Brown", "Taylor", "Wilson", "Clark", "Thompson", "Hughes", "Edwards", "Fraser", "Whitfield", "Ashworth", "Singh", "Sharma", "Reddy", "Tran", "Pham", "Fernández", "López", "Bianchi", "Colombo", "Novák", "Horváth", "Popescu", "Nielsen", "Lindqvist", "Bergström", "Ferreira", "Costa", "Ruiz", "Castillo", "Fischer", "Weber", "Wagner",
)
ROADS = ("Main", "Oak", "Maple", "High", "Church", "Station", "Park", "Victoria", "Mill", "Elm", "Washington", "King", "Queen", "Cedar", "Hill", "Lake", "North", "Bridge", "Green", "West", "Sunset", "Chestnut", "Market", "Spring")
GERMAN_ROADS = ("Haupt", "Bahnhof", "Garten", "Linden", "Schul", "Kirch", "Berg", "Goethe", "Schiller", "Wald", "Mozart", "Rosen", "Markt", "Dorf")
FRENCH_ROADS = ("la République", "Victor Hugo", "la Gare", "l'Église", "Jean Jaurès", "la Paix", "Pasteur", "la Fontaine", "Voltaire", "Gambetta")
PLACES = ("Springfield", "Boston", "Leeds", "Bristol", "Köln", "Hamburg", "München", "Lyon", "Nantes", "Toulouse", "Madrid", "Sevilla", "Torino", "Milano", "Utrecht", "Porto", "Dublin", "Chicago", "Denver", "Austin", "Oslo", "Wien", "Zürich", "New York", "San Diego", "Los Angeles", "Bad Homburg", "Saint-Denis", "Newcastle upon Tyne", "Salt Lake City")
CAPITALISED = ("Related", "Work", "Data", "Science", "Results", "Method", "Methods", "Discussion", "Conclusion", "Introduction", "Summary", "Annual", "Report", "Machine", "Learning", "Neural", "Networks", "Language", "Models", "Search", "Engine", "Public", "Library", "National", "Archive", "Research", "Group", "Open", "Source", "Digital", "History", "World", "North", "South", "Royal", "Society", "General", "Assembly", "Human", "Resources", "Customer", "Service", "Quality", "Control", "Early", "Modern", "Future", "Text", "Page", "Layout", "Deep", "Random", "Forest", "Image", "Table", "Index", "Query", "Press", "Journal", "Review", "Letters", "Studies", "Evaluation", "Setup", "Experimental", "Details", "Appendix", "Limitations", "Ethics", "Statement", "Dataset", "Benchmark", "Training", "Retrieval", "Augmented", "Generation", "Der", "Das", "Neue", "Daten", "Wissenschaft", "Sprache", "Bericht", "Ergebnisse", "Zeitung", "Les", "Données", "Recherche", "Langue")
ACCENTS = {"e": "éèë", "o": "öøó", "a": "áäåã", "u": "üú", "i": "íï", "c": "ç", "n": "ñ"}
TITLES = ("Dr.", "Prof.", "Ms.", "Mr.", "Mrs.", "Dr", "Mr", "Mrs", "Ms", "Professor", "Herr", "Frau", "Mme", "M.", "Sra.", "Sr.", "Miss", "Sir", "Prof. Dr.")
PARTICLES = ("van", "von", "de", "van der", "la", "di", "da", "del", "ten", "al", "bin")
STREETS = ("Street", "St.", "St", "Avenue", "Ave.", "Ave", "Road", "Rd", "Rd.", "Lane", "Ln", "Court", "Drive", "Dr", "Blvd", "Boulevard", "Crescent", "Place", "Terrace", "Way", "Close", "Square", "Hill", "Gardens", "Parkway", "Circle", "Grove", "Row", "Walk")
UNITS = ("Apt", "Apt.", "Suite", "Unit", "#", "Floor", "Room", "Ste", "Apartment")
GERMAN, FRENCH = ("weg", "straße", "strasse", "str.", "platz", "allee", "gasse", "ring", "ufer", "damm"), ("rue", "avenue", "boulevard", "quai", "place", "chemin", "allée", "impasse", "cours")
SPANISH, ITALIAN = ("Calle", "Avenida", "Plaza", "C/", "Paseo"), ("Via", "Viale", "Piazza", "Corso")
ENDINGS, TOWNS = ("croft", "dale", "ford", "mere", "stead", "wick", "wood", "ley", "shaw", "field"), ("bruck", "haven", "minster", "mont", "sworth", "vale", "ville", "burg", "field", "ton", "ham", "dorf", "heim", "stadt", "by", "port")
ONSETS = ("br", "cl", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "st", "t", "th", "v", "w", "z", "b", "kr", "s", "c", "j", "tr", "sh", "ch", "gr")
VOWELS = ("a", "e", "i", "o", "u", "au", "ie", "y", "ea", "oo")
CODAS = ("", "n", "r", "s", "l", "t", "m", "k", "ck", "ng", "rd", "nd", "st", "x", "z", "rt", "nn", "ll", "tt", "ss", "v", "d", "p", "sk", "lm", "rg", "b")
TAILS = ("example", "test", "invalid", "org", "com", "net", "edu", "de", "fr", "uk", "co.uk", "ac.uk", "eu", "io", "info", "example.org", "example.net", "example.com", "it", "es", "ch", "gov", "cn")
TERM_TAILS = ("", "", "rank", "net", "IR", "LM", "-v3", "-2", "-S", "-XL", "7B", "quo", "dim", "zen", "ix", "Former", "BERT", "Search", "Store", "GPT", "Lite", "DB")


class Writer:
    """Fills the slots, from known names and from new ones with the same endings."""

    def __init__(self, given: list[str], family: list[str], seed: int) -> None:
        self.r = random.Random(seed)
        self.given, self.family = given or list(GIVEN), family or list(FAMILY)

    def pick(self, options):
        return self.r.choice(options)

    def digits(self, n: int) -> str:
        return "".join(self.pick("0123456789") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))

    def coined(self, syllables: int = 2) -> str:
        return "".join(self.pick(ONSETS) + self.pick(VOWELS) for _ in range(syllables)).capitalize()

    def unheard(self) -> str:
        """A name like no known one: only where it stands and how it is written tell that it is a name."""
        return self.coined(self.r.randint(1, 3)) + self.pick(CODAS) + self.pick(("", "", "", "a", "o", "e", "i", "er", "y", "s"))

    def _part(self, known: list[str], common: tuple[str, ...]) -> str:
        chance = self.r.random()
        if chance < 0.45:
            return self.pick(common) if chance < 0.2 else self.unheard()
        name = self.pick(known)
        if self.r.random() < 0.5:
            other = self.pick(known)
            cut = max(2, len(name) - self.r.randint(3, 6))
            name = self.coined(self.r.randint(1, 2)) + name[cut:].lower() if " " not in name else name
            if self.r.random() < 0.15:
                name = self.coined(1) + other[1:].lower() if " " not in other else other
        if self.r.random() < 0.15:
            at = self.r.randrange(1, len(name))
            name = name[:at] + self.pick(ACCENTS.get(name[at], (name[at],))) + name[at + 1 :]
        return name

    def given_name(self) -> str:
        return self._part(self.given, GIVEN)

    def family_name(self) -> str:
        name = self._part(self.family, FAMILY)
        if " " not in name and self.r.random() < 0.2:
            name = f"{self.pick(PARTICLES)} {name}" if self.r.random() < 0.7 else self.pick(("O'", "Mac", "Mc", "D'", "O’")) + name
        return name

    def name(self) -> str:
        given, family = self.given_name(), self.family_name()
        if self.r.random() < 0.15:
            given += "-" + self.given_name()
        if self.r.random() < 0.08:
            family += "-" + self._part(self.family, FAMILY)
        if self.r.random() < 0.18:
            given += f" {self.pick('ABCDEFGHJKLMPRSTVW')}." if self.r.random() < 0.7 else f" {self.given_name()}"
        form = self.r.random()
        if form < 0.1:
            given, family = given.upper(), family.upper()
        elif form < 0.2:
            family = family.upper()
        return f"{family}, {given}" if self.r.random() < 0.25 else f"{given} {family}"

    def email(self) -> str:
        plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if c.isascii() and c.isalpha()).lower() or "x"
        g, f = plain(self.given_name()), plain(self.family_name().split()[-1])
        local = self.pick((f"{g}.{f}", f"{g}_{f}", f"{g[0]}{f}", f"{g[0]}.{f}", f"{f}-{g[0]}", f"{f}{self.digits(2)}", f"{g}{self.digits(2)}", g, f"{g}{f}", self.pick(("info", "office", "help", "contact", "sales", "team")), f"{g[0]}{f[:3]}{self.digits(3)}"))
        if self.r.random() < 0.15:
            local += "+" + self.pick(("news", "list", "work", "shop", "alerts"))
        if self.r.random() < 0.12:
            local = "".join(c.upper() if i == 0 or not local[i - 1].isalpha() else c for i, c in enumerate(local))
        host = self.pick(TAILS) if self.r.random() < 0.3 else f"{self.coined(3).lower()}{self.pick(('', '', '-lab', '.ac', '.mail', '-uni'))}.{self.pick(TAILS)}"
        if "." not in host:
            host = self.pick(("example.", "mail.", "web.")) + host
        form = self.r.random()
        if form < 0.66:
            out = f"{local}@{host}"
            return out.upper() if form < 0.05 else out
        if form < 0.9:
            at = self.pick((" (at) ", " [at] ", "{at}", "(at)", "[at]", " {at} ", " <at> ", " AT ", " at ", " @ "))
            return f"{local}{at}{host}"
        return f"{local}{self.pick((' AT ', ' [at] ', ' (at) ', ' at '))}{host.replace('.', self.pick((' DOT ', ' [dot] ', ' (dot) ', ' dot ')))}"

    def phone(self) -> str:
        d, r = self.digits, self.r
        a, b, c = d(3), d(3), d(4)
        pairs = [d(2) for _ in range(5)]
        country = self.pick((1, 7, 20, 27, 30, 31, 32, 33, 34, 39, 41, 43, 44, 45, 46, 47, 48, 49, 55, 61, 81, 86, 91, 351, 353, 358, 420))
        return self.pick((
            f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}.{b}.{c}", f"{a}-{b}-{c}", f"+1{a}{b}{c}", f"1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"{a} {b} {c}",
            f"+44 20 {c} {d(4)}", f"020 {c} {d(4)}", f"+44 (0)20 {c} {d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(3)} {d(6)}", f"0{d(4)} {d(6)}", f"07{d(3)} {d(6)}", f"+44 7{d(3)} {d(6)}", f"(0{d(3)}) {d(3)} {d(4)}", f"+44 (0) {d(4)} {d(6)}",
            f"+49 {d(2)} {d(6)}", f"+49 {d(3)} {d(7)}", f"0{d(2)}/{d(6)}", f"0{d(2)}/{d(4)}-{d(3)}", f"0{d(2)}/{d(5)}-{d(3)}", f"0{d(3)}/{d(5)}-{d(2)}", f"+49 {d(2)} {d(5)} {d(3)}", f"1-{a}-{b}-{c}", f"1 {a} {b} {c}", f"(0{d(2)}) {d(5)} {d(3)}", f"0{d(3)}-{d(7)}", f"0{d(3)} {d(7)}", f"0049 {d(2)} {d(8)}", f"0049 {d(2)} {d(5)}{d(3)}", f"+49 (0){d(2)} {d(4)} {d(4)}",
            f"0{d(1)} {' '.join(pairs[:4])}", f"0{d(1)} {' '.join(pairs[:4])}", f"0{d(1)} {' '.join(pairs[:4])}", f"0{d(1)}.{'.'.join(pairs[:4])}", f"0{d(1)}.{'.'.join(pairs[:4])}", f"+33 {d(1)} {' '.join(pairs[:4])}", f"+33 (0){d(1)} {' '.join(pairs[:4])}", f"0{d(1)}{''.join(pairs[:4])}", f"+{country} {d(2)} {d(3)} {d(4)}", f"+{country} {d(9)}", f"+{country}-{d(2)}-{d(4)}-{d(4)}", f"00{country} {d(3)} {d(6)}", f"1{d(2)} {d(4)} {d(4)}", f"1{d(10)}", f"0{d(2)}-{d(8)}", f"9{d(2)} {d(2)} {d(2)} {d(2)}",
        )) if r.random() < 0.97 else f"{d(3)} {d(4)}"

    def plain_phone(self) -> str:
        while True:
            out = self.phone()
            if out.startswith(("+", "(", "00")) or out.startswith("0") and " " in out or out.count("-") > 1 or out.count(".") > 1 or "/" in out:
                return out

    def identity(self) -> str:
        d, a = self.digits, self.letters
        return self.pick((
            f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{self.pick('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{self.pick('012')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{self.pick('12')}{d(14)}", f"{a(2)} {d(2)} {d(2)} {d(2)} {a(1)}", f"{a(2)}{d(6)}{a(1)}",
            f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(11)}", f"{d(3)} {d(3)} {d(3)}", f"{d(9)}", f"{a(1)}{d(8)}", f"{a(1)}{d(2)}{a(1)}{d(2)}{a(1)}{d(2)}", f"{a(2)}{d(7)}", f"{a(1)}{d(7)}", f"{d(8)}{a(1)}", f"{a(1)}-{d(7)}-{a(1)}", f"{a(2)}-{d(6)}-{d(1)}", f"{a(2)}-{d(6)}", f"{a(1)}{d(3)}-{d(4)}-{d(4)}", f"{a(3)}-{d(5)}", f"{a(3)}{d(6)}", f"E{d(6)}", f"{d(2)}-{d(7)}", f"{d(4)}-{d(4)}-{d(2)}", f"{d(4)} {d(4)} {d(4)}", f"{d(2)}/{d(3)}/{d(5)}", f"{d(18)}", f"{d(17)}X", f"{a(6)}{d(2)}{a(1)}{d(2)}{a(1)}{d(3)}{a(1)}", f"{a(2)} {d(7)}", f"{d(6)}-{d(4)}", f"{d(8)}-{d(1)}", f"00{d(7)}", f"{a(2)}-{d(4)}-{d(4)}",
        ))

    def town(self) -> str:
        if self.r.random() < 0.35:
            return self.pick(PLACES)
        return self.coined(self.r.randint(1, 2)).rstrip("aeiouy") + self.pick(TOWNS)

    def road(self) -> str:
        if self.r.random() < 0.4:
            return self.pick(ROADS)
        return self.coined(1).rstrip("y") + self.pick(("", "m", "l", "r")) + self.pick(("b", "d", "r", "")) + "e" * self.r.randint(0, 1) + self.pick(ENDINGS)

    def address(self) -> str:
        r, number, line = self.r, str(self.r.randint(1, 249) if self.r.random() < 0.8 else self.r.randint(250, 9999)), self.pick((", ", ", ", ", ", ",\n", "\n"))
        form = r.random()
        if form < 0.3:
            unit = f", {self.pick(UNITS)} {r.randint(1, 99)}{self.pick(('', '', *'ABCD'))}" if r.random() < 0.4 else ""
            code = f", {self.letters(2)} {self.digits(5)}" if r.random() < 0.75 else ""
            return f"{number} {self.road()} {self.pick(STREETS)}{unit}{line}{self.town()}{code}"
        if form < 0.45:
            code = self.pick((f" {self.letters(2)}{self.digits(1)} {self.digits(1)}{self.letters(2)}", f" {self.letters(1)}{self.digits(2)} {self.digits(1)}{self.letters(2)}", f", {self.letters(2)}{self.digits(2)} {self.digits(1)}{self.letters(2)}")) if r.random() < 0.9 else ""
            flat = f"{self.pick(('Flat', 'Apartment', 'Unit'))} {r.randint(1, 40)}{self.pick(('', '', 'A', 'b'))}, " if r.random() < 0.6 else ""
            return f"{flat}{number} {self.road()} {self.pick(STREETS)}{line}{self.town()}{code}"
        if form < 0.56:
            return f"{self.pick(('P.O. Box', 'P.O. Box', 'PO Box', 'P. O. Box', 'Postfach', 'BP'))} {self.digits(r.randint(2, 5))}{line}{self.town()}{self.pick((' ', ', '))}{self.digits(5) if r.random() < 0.85 else ''}".rstrip(" ,")
        if form < 0.76:
            road = self.pick((self.road(), self.pick(GERMAN_ROADS), self.pick(GERMAN_ROADS) + "er ")) + self.pick(GERMAN)
            if " " in road:
                road = road.split(" ")[0] + " " + road.split(" ")[1].capitalize() if r.random() < 0.8 else f"{self.pick(('Am', 'An der', 'Im', 'Zum'))} {self.road()}"
            return f"{road} {number}{self.pick(('', '', '', 'a', 'b', ' c'))}{line}{self.digits(5 if r.random() < 0.85 else 4)} {self.town()}"
        if form < 0.92:
            road = f"{self.pick(('', '', 'de ', 'du ', 'des '))}{self.road()}" if r.random() < 0.5 else self.pick((f"de {self.pick(FRENCH_ROADS)}", self.pick(FRENCH_ROADS)))
            return f"{number}{self.pick(('', '', '', ' bis', ' ter'))}{self.pick((' ', ', '))}{self.pick(FRENCH)} {road}{line}{self.digits(5)} {self.town()}"
        way = self.pick((f"{self.pick(SPANISH)} {self.road()} {number}", f"{self.pick(ITALIAN)} {self.road()} {number}", f"{self.pick(ITALIAN)} {self.family_name()}, {number}", f"{self.road()}laan {number}", f"{self.road()}straat {number}"))
        return f"{way}{line}{self.pick((self.digits(5), self.digits(4) + ' ' + self.letters(2)))} {self.town()}"

    def words(self) -> str:
        return " ".join(self.pick(WORDS) for _ in range(self.r.randint(1, 6)))

    def capitalised(self) -> str:
        return " ".join(self.pick(CAPITALISED) for _ in range(self.r.randint(1, 3)))

    def opener(self) -> str:
        return self.pick((*OPENERS, self.pick(WORDS).capitalize(), self.pick(WORDS).capitalize(), self.coined(2) + "ly", self.coined(2) + "ing", self.coined(2) + "s"))

    def noun(self) -> str:
        return self.pick(NOUNS) if self.r.random() < 0.5 else self.coined(self.r.randint(1, 2)) + self.pick(CODAS) + self.pick(("ung", "heit", "keit", "schaft", "tion", "ungen", "tät", "nis", "e", "en"))

    def term(self) -> str:
        return self.coined(self.r.randint(1, 2)).rstrip("aeiouy") + self.pick(("", "on", "el", "ept", "arn", "usk", "", "er", "is")) + self.pick(TERM_TAILS)

    def line(self, form: str) -> list[tuple[str, str | None]]:
        """(text, kind) stretches of a filled line."""
        filled = {
            "N": (self.name, "name"), "E": (self.email, "email"), "P": (self.phone, "phone"), "Q": (self.plain_phone, "phone"), "I": (self.identity, "id_number"), "A": (self.address, "address"),
            "F": (self.family_name, None), "G": (self.given_name, None), "L": (lambda: self.letters(1), None), "S": (lambda: f"{self.road()} {self.pick(STREETS)}", None), "C": (self.town, None), "M": (self.term, None), "K": (self.capitalised, None), "V": (self.opener, None), "B": (self.noun, None),
            "D": (lambda: str(self.r.randint(1, 99)), None), "T": (lambda: self.pick(TITLES), None), "W": (self.words, None), "Y": (lambda: str(self.r.randint(1950, 2029)), None),
            "UP": (lambda: " ".join(self.pick((*WORDS, self.coined(2), self.term(), self.capitalised())) for _ in range(self.r.randint(2, 9))).upper(), None),
            "CJK": (lambda: "".join(self.pick(CHARACTERS) for _ in range(self.r.randint(2, 14))), None),
            "H": (lambda: "".join(self.pick("0123456789abcdef") for _ in range(12)), None), "D1": (lambda: self.digits(1), None), **{f"R{n}": (lambda n=n: self.digits(n), None) for n in range(2, 10)},
        }
        out: list[tuple[str, str | None]] = []
        rest = form.replace("{{", "\0").replace("}}", "\1")
        while "{" in rest:
            before, rest = rest.split("{", 1)
            slot, rest = rest.split("}", 1)
            make, kind = filled[slot]
            out += [(before, None), (make(), kind)]
        out.append((rest, None))
        return [(t.replace("\0", "{").replace("\1", "}"), kind) for t, kind in out if t]


def table(given: list[str], family: list[str], times: int = 14, seed: int = 11) -> list[list[tuple[str, str | None]]]:
    """The labelled table: every line ``times`` times, between other lines."""
    w = Writer(given, family, seed)
    rows = []
    everything = LINES + PLAIN
    for form in everything * times:
        row = w.line(form)
        if w.r.random() < 0.6:
            row = [*w.line(w.pick(everything)), (w.pick((" ", " ", "\n", "\n\n")), None), *row]
        if w.r.random() < 0.5:
            row = [*row, (w.pick((" ", " ", "\n", ". ")), None), (w.words().capitalize() + ".", None)]
        if w.r.random() < 0.2:  # hard-wrapped, or with wide gaps
            gap = w.pick(("\n", "\n", "  "))
            row = [("".join(gap if c == " " and w.r.random() < 0.15 else c for c in t), kind) for t, kind in row]
        rows.append(row)
    return rows
