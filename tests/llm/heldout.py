"""Sentences of other frames than those of the labelled table, with their personal data in double square brackets: [[kind|text]]."""

SENTENCES = """
Minutes were taken by [[name|Harriet Boyle]] and approved by [[name|Tobias Renner]] a week later.
When [[name|Siddharth Menon]] joined the firm, nobody knew that he spoke Welsh.
The cello part was played by [[name|Agnieszka Wrona]], who had rehearsed for months.
I still owe [[name|Patrick Lonergan]] a reply about the boat.
Neighbours describe [[name|Yolanda Pérez]] as generous and quiet.
The bakery passed from [[name|Ulrich Stamm]] to his niece [[name|Petra Stamm]] in 1998.
Could you forward the invoice to [[email|billing.desk@northgate-tools.com]] before Friday?
Subscribers may write to [[email|readers_corner@gazette.co.uk]]; replies take a fortnight.
For refunds, [[email|refunds@kestrel.shop]] is monitored around the clock.
His private mail, [[email|o.brandt77@posteo.de]], bounced twice.
Reach the organisers through [[email|hello (at) winterfest.org]] if you need a stall.
The form bounced to [[email|pascal.vidal [at] laposte.net]] without notice.
After hours, the plumber answers [[phone|0161 496 0721]] until ten.
Bookings are taken on [[phone|+44 1632 960442]], never by letter.
The clinic rang from [[phone|(415) 555-0132]] twice this morning.
Leave a message at [[phone|202-555-0178]] and we will ring back.
Unser Notdienst hat die Nummer [[phone|+49 89 636 48018]] rund um die Uhr.
Die Praxis ist unter [[phone|0711/9876543]] nur vormittags besetzt.
Pour réserver une table, composez le [[phone|01 42 68 53 00]] avant midi.
Le gardien répond au [[phone|06 12 34 56 78]] jour et nuit.
Reservas en el [[phone|+34 912 345 678]] de lunes a viernes.
The clerk copied social security number [[id_number|412-68-9075]] onto the wrong form.
Border officers noted passport [[id_number|K4839201]] and let the bus go.
Please quote your national insurance number [[id_number|QQ 12 34 56 C]] in every letter.
A driving licence with the number [[id_number|D6101-40706-60905]] was handed in at reception.
Her tax identification number, [[id_number|86 095 742 719]], had a typing error.
The guard wrote down staff number [[id_number|SEC-20417]] from the lanyard.
Im Antrag fehlt die Personalausweisnummer [[id_number|L22N01Y47]] der Mutter.
Sa carte d'identité, numéro [[id_number|880692310285]], est périmée.
El pasaporte [[id_number|AAB123456]] caducó en marzo.
The parcel for [[name|Deborah Finch]] went to [[address|48 Larkspur Avenue, Guildford GU2 7XH]] by mistake.
We are moving the workshop to [[address|1200 Harbor Boulevard, Suite 310, Oakland, CA 94607]] in May.
Applications by post only: [[address|PO Box 7781, Edinburgh EH3 9QN]].
The plaque hangs at [[address|Flat 6, 15 Abbey Road, Bath BA2 4PQ]], next to the bell.
Das Museum, [[address|Königsallee 27, 40212 Düsseldorf]], bleibt montags geschlossen.
Die Werkstatt zog in die [[address|Ahornstraße 5a, 10785 Berlin]] um.
Le cabinet se trouve [[address|12 rue des Tanneurs, 37000 Tours]], au deuxième étage.
L'atelier déménage [[address|8 bis, avenue Foch, 54000 Nancy]] cet été.
La tienda está en [[address|Calle Mayor 31, 28013 Madrid]] desde 1970.
Lo studio si trova in [[address|Via Garibaldi 9, 20121 Milano]] da anni.
Es berichtete [[name|Annegret Vollmer]] aus dem Stadtrat.
Die Rede hielt [[name|Matthias Körber]], anschließend gab es Kuchen.
Gestern rief [[name|Leonie Hartwig]] an und fragte nach dem Schlüssel.
Le maire, [[name|Bernard Castaing]], a coupé le ruban.
Hier, [[name|Mathilde Roussel]] et [[name|Antoine Girard]] ont gagné le tournoi.
Ayer [[name|Raquel Montero]] presentó la propuesta al consejo.
Ieri [[name|Giulia Marchetti]] ha aperto la mostra.
Gisteren belde [[name|Joost Verhoeven]] over de fiets.
王经理说他的邮箱是 [[email|wang.jl@qq.com]]，请尽快回复。
有事请打 [[phone|138 1234 5678]] 找我。
快递寄到 [[address|88 Nanjing Road, Shanghai 200001]] 就行。
The board thanked [[name|Olumide Bankole]], [[name|Ruth Abrams]] and [[name|Cheng Li]].
Signed on behalf of the tenants: [[name|Marion Tate]].
Her lawyer, [[name|Gideon Sachs]], declined to comment.
Goals came from [[name|Ferran Soler]] (12') and [[name|Tomasz Zając]] (77').
In 2016 [[name|Imani Carter]] opened a second shop on the coast.
The nurse on duty, [[name|Ewa Malinowska]], kept the key.
[[name|Douglas Pryor]] will chair the panel; [[name|Nadia Haddad]] takes notes.
The winner is [[name|Kofi Asante]] with nine points.
Tenants: [[name|Lowell, Brenda]]; [[name|Ortiz, Manuel]]
Two trees fell on the road between the villages last night.
The committee met on 12 March 2019 and again in early June.
Prices rose by 3.4 percent while wages stayed where they were.
Our server answered 98,214 requests with a median of 12.5 ms.
See Chapter 7, Table 3 and the map on page 214.
The part 4471-220-19 no longer fits the newer engine.
Version 2.14.3 fixes the crash that appeared in 2.14.1.
The recipe needs 250 g of flour, 3 eggs and 125 ml of milk.
Order 20481937 left the depot at 14:35:10 on 2021-11-04.
Okafor and Lindqvist (2015) disagree with Mensah et al. (2019).
The Pythagorean theorem and the Fourier transform were on the exam.
Berlin, Paris and Madrid sent delegates to the Summer Meeting.
The River Tamar forms the border for most of its length.
Heinemann Press published the Annual Review of Gardens in 2004.
Set the decorator @retry on the function and pass max=5.
The Great Northern Railway closed its Leeds branch in 1964.
Blue Whale and Red Fox are the names of the two meeting rooms.
Der Zug nach Hamburg fährt um 9.42 Uhr von Gleis 7.
Les résultats de 2020 dépassent ceux de 2019 de 12 points.
会议在三月十二日举行，共有二百人参加。
The batch sizes were 64, 128 and 256 with learning rate 0.001.
According to Table 2, Model B needs 1,024 units and 16 layers.
ISBN 978-0-14-044913-6 is out of print.
Grid cells 100-200-300 were left empty on purpose.
"""

#: Further frames, each filled three times from the lists below.
FRAMES = """
The lifeguard, {name}, pulled two swimmers out.
A statue of {name} stands by the harbour.
{name} refused to pay the fine.
Nobody had warned {name} about the dog.
The poems of {name} were read aloud.
Yours, {name}
The coach picked {name} over {name}.
A letter to {name} was never opened.
Mrs. {name} keeps bees behind the chapel.
{name}, who turned ninety, planted an oak.
Interpreter: {name}, reachable via {email}.
Complaints go straight to {email}, says {name}.
The newsletter comes from {email} every month.
Feedback welcome: {email}
Our vet has a new line, {phone}, since Monday.
Ring {phone} if the lift gets stuck.
The number on the van was {phone}.
Night porter: {phone}
Contact the harbour master by telephone ({phone}) or {email}.
The passport of the skipper, number {passport}, had expired.
Crew list: {name}, passport {passport}; {name}, passport {passport}.
The form asks for a social security number, here {ssn}.
SSN {ssn} was found in the log.
Deliveries for {name}: {address}.
The auction takes place at {address}.
Keys were left at {address} on Sunday.
Our new shop: {address}
She grew up near {address}, above a bakery.
Besucht hat uns {name} aus Graz.
Den Preis bekam {name} für ihr Lebenswerk.
Wenden Sie sich an {name} ({email}).
L'exposition de {name} ouvre jeudi.
Merci à {name} pour les photos.
La novela de {name} ganó el premio.
Ha telefonato {name} da Torino.
Landlord {name} raised the rent, wrote {name} to the council.
The tuba belongs to {name}; call {phone}.
Treasurer's report by {name}, seconded by {name}.
Item 4: {name} to order chairs.
{name} ({phone}) collects the keys at {address}.
"""
FILLS = {
    "name": ("Harold Pemberton", "Ximena Robles", "Anjali Deshpande", "Cormac Healy", "Brigitte Lehner", "Wanda Sikorska", "Teodor Ilić", "Maeve Callaghan", "Josephine Aldous", "Kenji Morita", "Lorenzo Vitale", "Henrike Jost", "Bartholomew Quill", "Noémie Charpentier", "Rosalind Thwaite", "Ibrahim Sesay"),
    "email": ("m.thwaite@harbour-trust.org", "orders+spring@seedbank.eu", "jost_h@uni-graz.at", "clerk (at) townhall.gov", "SUPPORT@LANTERN.IO", "vitale.l@studio-nove.it", "c.healy at eircom dot net"),
    "phone": ("+353 1 496 0123", "020 7946 0958", "(312) 555-0147", "+43 316 225 781", "503-555-0166", "+39 011 496 5512", "0141 496 0380"),
    "passport": ("M7730215", "553810274", "PB0948117", "X4471923K"),
    "ssn": ("219-09-9999", "078-05-1120", "551-73-4406"),
    "address": ("7 Quayside Terrace, Whitby YO21 3PU", "350 Alder Street, Portland, OR 97205", "Mariahilfer Straße 84, 1070 Wien", "19, quai Voltaire, 75007 Paris", "P.O. Box 418, Duluth, MN 55801", "22b Seaview Road, Cromer, NR27 9AT"),
}
#: Written after the labelled table and the features were settled, and not used to choose them.
FRESH = """
The orchard was planted by [[name|Winifred Garland]] before the war.
Its first headmaster, [[name|Rowan McAllister]], taught Greek and swimming.
Rumour has it that [[name|Pavel Dvořák]] sold the mine twice.
[[name|Esperanza Villanueva]] arrived with two suitcases and a parrot.
At noon [[name|Jasper Kettering]] locked the gate, and [[name|Lydia Frost]] hid the key.
A portrait shows [[name|Hedwig Brandis]] in a green coat.
The ferry was named after [[name|Duncan Abernethy]].
We heard from [[name|Marisol Quintero]] only in spring.
Our guide, [[name|Tenzin Dorje]], carried the rope.
The essay prize went to [[name|Callum Rutherford]] and [[name|Adaeze Nwosu]].
Der Imker [[name|Gernot Wiesner]] hat zwölf Völker.
Am Sonntag spielt [[name|Friederike Lohse]] die Orgel.
Le boulanger [[name|Gaspard Meunier]] ferme en août.
El jardín lo cuida [[name|Ramiro Escudero]] desde abril.
Book the hall with [[name|Fenella Marsh]], [[email|hall.bookings@larkhill.org.uk]], [[phone|01865 496 012]].
Spare keys: [[phone|+61 2 5550 1234]] (ask for the caretaker).
The vicar's fax machine still answers at [[phone|01273 496088]].
Lost cat, white paws, please text [[phone|07700 900461]].
Orders over ten go to [[email|wholesale@oatandrye.example]].
Kündigungen nimmt [[email|kundendienst@stadtwerke-xy.de]] entgegen.
The visa stamp sits in passport [[id_number|L8820417]], page nine.
Her social security number is [[id_number|601-33-7781]], not the one on file.
Please present licence number [[id_number|P5520-1187-3094]] at the counter.
Steuer-ID [[id_number|47 036 892 815]] bitte angeben.
The piano is stored at [[address|91 Thornbury Lane, Exeter EX4 6TP]].
Visitors park behind [[address|2750 Juniper Drive, Boulder, CO 80302]].
Das Archiv liegt in der [[address|Schillerstraße 14, 99423 Weimar]].
La poste est au [[address|33 rue du Marché, 67000 Strasbourg]].
Snow fell on the Black Forest and the Swiss Alps for three days.
The Ministry of Transport opened Route 61 in October 1988.
Chapter 12 lists 4,096 species in 311 genera.
Old Trafford and Wembley Stadium sold out within hours.
"""
KINDS = {"passport": "id_number", "ssn": "id_number"}


def marked_cases(sentences: str) -> list[tuple[str, set[tuple[str, str]]]]:
    """(sentence, its personal data) of sentences with marked data."""
    import re

    return [(re.sub(r"\[\[\w+\|(.*?)\]\]", r"\1", line), set(re.findall(r"\[\[(\w+)\|(.*?)\]\]", line))) for line in sentences.strip().splitlines()]


def cases() -> list[tuple[str, set[tuple[str, str]]]]:
    """(sentence, its personal data) of all held-out sentences."""
    import re

    out = marked_cases(SENTENCES)
    turn = 0
    for line in FRAMES.strip().splitlines():
        for _ in range(3):
            text, own = line, set()
            while m := re.search(r"\{(\w+)\}", text):
                value = FILLS[m[1]][turn % len(FILLS[m[1]])]
                turn += 1
                own.add((KINDS.get(m[1], m[1]), value))
                text = text[: m.start()] + value + text[m.end() :]
            out.append((text, own))
    return out
