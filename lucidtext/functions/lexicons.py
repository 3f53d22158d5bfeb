"""Fixed values of the rules: word lists, thresholds, weights.

They decide results, so they stand here as they are meant, each list together.
"""

from __future__ import annotations

# --- foreign words: (word, plainer word, difficulty, category); fixed values
FOREIGN_WORDS = (
    ("administration", "Verwaltung", 0.9, "verwaltung"),
    ("service", "Dienst", 0.7, "allgemein"),
    ("formular", "Formblatt", 0.6, "verwaltung"),
    ("information", "Nachricht", 0.5, "kommunikation"),
    ("dokumentation", "Unterlagen", 0.8, "verwaltung"),
    ("kommunikation", "Gespräch", 0.7, "kommunikation"),
    ("organisation", "Gruppe", 0.6, "struktur"),
    ("institution", "Einrichtung", 0.8, "struktur"),
    ("konzept", "Plan", 0.7, "planung"),
    ("prozess", "Ablauf", 0.6, "aktion"),
    ("implementierung", "Umsetzung", 0.9, "aktion"),
    ("modifikation", "Änderung", 0.8, "aktion"),
    ("realisierung", "Verwirklichung", 0.8, "aktion"),
    ("konstruktion", "Aufbau", 0.7, "struktur"),
    ("produktion", "Herstellung", 0.6, "aktion"),
    ("analyse", "Untersuchung", 0.7, "wissenschaft"),
    ("synthese", "Zusammenfassung", 0.8, "wissenschaft"),
    ("evaluation", "Bewertung", 0.8, "wissenschaft"),
    ("interpretation", "Deutung", 0.8, "wissenschaft"),
    ("definition", "Erklärung", 0.6, "wissenschaft"),
    ("funktion", "Aufgabe", 0.5, "allgemein"),
    ("situation", "Lage", 0.5, "allgemein"),
    ("position", "Stelle", 0.5, "ort"),
    ("tradition", "Brauch", 0.6, "kultur"),
    ("diskussion", "Gespräch", 0.6, "kommunikation"),
    ("präsentation", "Vorstellung", 0.7, "kommunikation"),
    ("demonstration", "Vorführung", 0.8, "aktion"),
    ("illustration", "Bild", 0.7, "darstellung"),
    ("publikation", "Veröffentlichung", 0.8, "kommunikation"),
    ("navigation", "Führung", 0.7, "bewegung"),
    ("instruktion", "Anweisung", 0.7, "kommunikation"),
    ("konstruktiv", "aufbauend", 0.7, "eigenschaft"),
    ("alternativ", "anders", 0.6, "eigenschaft"),
    ("intensiv", "stark", 0.6, "eigenschaft"),
    ("aktiv", "tätig", 0.5, "eigenschaft"),
    ("passiv", "untätig", 0.6, "eigenschaft"),
    ("positiv", "gut", 0.4, "eigenschaft"),
    ("negativ", "schlecht", 0.5, "eigenschaft"),
    ("effektiv", "wirksam", 0.7, "eigenschaft"),
    ("optimal", "bestmöglich", 0.7, "eigenschaft"),
    ("digital", "elektronisch", 0.6, "technik"),
    ("global", "weltweit", 0.5, "ort"),
    ("lokal", "örtlich", 0.5, "ort"),
    ("zentral", "mittig", 0.6, "ort"),
    ("regional", "örtlich begrenzt", 0.7, "ort"),
)
# --- words that look foreign and are everyday German; fixed values
COMMON_WORDS = (
    "station", "nation", "aktion", "reaktion", "attraktion", "gmbh", "ag", "kg", "ev", "gbr", "ohg", "kgaa", "tv", "pc", "dvd", "cd", "usb", "wlan",
    "dsl", "pkw", "lkw", "bahn", "db", "post", "dhl", "dokumentation", "auto", "hotel", "restaurant", "café", "kino", "theater", "museum", "sport",
    "team", "training", "coach", "fitness", "hobby", "computer", "internet", "email", "handy", "smartphone", "tablet", "büro", "manager", "chef",
    "firma", "business", "meeting", "party", "festival", "konzert", "band", "musik", "radio", "foto", "video", "film", "kamera", "studio", "design",
    "system", "online", "offline", "analog", "software", "hardware", "update", "upgrade", "download", "upload", "normal", "formal", "universität",
    "student", "professor", "diplom", "bachelor", "master", "seminar", "kurs", "test", "prüfung", "note", "projekt", "doktor", "patient", "therapie",
    "diagnose", "praxis", "klinik", "operation", "medizin", "vitamin", "antibiotikum", "verwaltung", "behörde", "amt", "abteilung", "bearbeitung",
    "einführung", "durchführung", "ausführung", "aufführung", "umgestaltung", "gestaltung", "entwicklung", "verbesserung", "betreuung", "beratung",
    "unterstützung", "förderung", "untersuchung", "bewertung", "einschätzung", "änderung", "erweiterung", "kürzung", "verlängerung", "beschleunigung",
    "verzögerung", "vereinfachung", "verkomplizierung", "klärung", "lösung", "behandlung", "beendigung", "erhaltung", "erhöhung", "verringerung",
    "steigerung", "senkung", "vermehrung", "verminderung", "verstärkung",
)
# --- words with endings like those of foreign words; fixed values
ACRONYMS = ("consultant", "plant", "relevant", "präsent", "patient", "student", "agent")
# --- endings of foreign words by difficulty, with their score; fixed values
FOREIGN_ENDINGS = (
    (0.6, ("tion", "sion", "ität", "ismus", "ment", "ant", "ent", "anz", "enz")),
    (0.4, ("al", "ell", "iv", "ar", "är", "ik", "ur")),
    (0.2, ("ös", "os", "isch")),
)
# --- words of Latin or Greek stock; fixed values
GREEK_STEMS = (".*graph(ie|isch|en)$", ".*log(ie|isch|en)$", ".*phon(ie|isch|en)$", ".*krat(ie|isch|en)$", ".*nom(ie|isch|en)$", ".*phil(ie|isch|en)$")

# --- word length; fixed values
MAX_SYLLABLES, MAX_CHARS = 3, 12
MORPH_PREFIXES = ("un", "ver", "ent", "er", "be", "ge", "über", "unter", "miss")
MORPH_SUFFIXES = ("ung", "heit", "keit", "schaft", "ismus", "ation", "ierung")
MORPH_FOREIGN = ("tion", "sion", "ment", "enz", "anz", "ismus")

# --- complex words: (word, plainer words, category); words that are never complex; fixed values
COMPLEX_WORDS = (
    ("administration", "Verwaltung", "Fremdwort"),
    ("implementieren", "umsetzen", "Fremdwort"),
    ("implementation", "Umsetzung", "Fremdwort"),
    ("evaluieren", "prüfen", "Fremdwort"),
    ("evaluation", "Prüfung", "Fremdwort"),
    ("konzept", "Plan, Idee", "Fremdwort"),
    ("konzeption", "Planung", "Fremdwort"),
    ("kommunikation", "Gespräch, Austausch", "Fremdwort"),
    ("kommunizieren", "sprechen, sich austauschen", "Fremdwort"),
    ("information", "Auskunft, Nachricht", "Fremdwort"),
    ("informieren", "mitteilen, sagen", "Fremdwort"),
    ("organisation", "Gruppe, Verein", "Fremdwort"),
    ("organisieren", "planen, vorbereiten", "Fremdwort"),
    ("dokumentation", "Aufschreibung, Unterlagen", "Fremdwort"),
    ("dokumentieren", "aufschreiben", "Fremdwort"),
    ("präsentation", "Vorstellung, Vortrag", "Fremdwort"),
    ("präsentieren", "vorstellen, zeigen", "Fremdwort"),
    ("diskussion", "Gespräch, Besprechung", "Fremdwort"),
    ("diskutieren", "besprechen", "Fremdwort"),
    ("akzeptieren", "annehmen, einverstanden sein", "Fremdwort"),
    ("analysieren", "untersuchen, prüfen", "Fremdwort"),
    ("optimieren", "verbessern", "Fremdwort"),
    ("realisieren", "verwirklichen, umsetzen", "Fremdwort"),
    ("ignorieren", "nicht beachten", "Fremdwort"),
    ("tolerieren", "dulden, erlauben", "Fremdwort"),
    ("integrieren", "einbeziehen, aufnehmen", "Fremdwort"),
    ("koordinieren", "abstimmen, planen", "Fremdwort"),
    ("korrigieren", "verbessern, richtig machen", "Fremdwort"),
    ("kontrollieren", "prüfen, überprüfen", "Fremdwort"),
    ("produzieren", "herstellen, machen", "Fremdwort"),
    ("konstruieren", "bauen, entwerfen", "Fremdwort"),
    ("funktionieren", "arbeiten, gehen", "Fremdwort"),
    ("existieren", "da sein, es gibt", "Fremdwort"),
    ("resultieren", "sich ergeben", "Fremdwort"),
    ("initiieren", "beginnen, starten", "Fremdwort"),
    ("definieren", "festlegen, bestimmen", "Fremdwort"),
    ("identifizieren", "erkennen, feststellen", "Fremdwort"),
    ("qualifizieren", "befähigen", "Fremdwort"),
    ("quantifizieren", "zählen, messen", "Fremdwort"),
    ("differenzieren", "unterscheiden", "Fremdwort"),
    ("spezialisieren", "sich auf etwas ausrichten", "Fremdwort"),
    ("generalisieren", "verallgemeinern", "Fremdwort"),
    ("visualisieren", "zeigen, darstellen", "Fremdwort"),
    ("maximieren", "so groß wie möglich machen", "Fremdwort"),
    ("minimieren", "so klein wie möglich machen", "Fremdwort"),
    ("garantieren", "versprechen, sichern", "Fremdwort"),
    ("riskieren", "wagen", "Fremdwort"),
    ("profitieren", "Vorteil haben", "Fremdwort"),
    ("investieren", "Geld ausgeben für", "Fremdwort"),
    ("finanzieren", "bezahlen, Geld geben für", "Fremdwort"),
    ("kompensieren", "ausgleichen", "Fremdwort"),
    ("demonstrieren", "zeigen, vorführen", "Fremdwort"),
    ("illustrieren", "zeigen, erklären", "Fremdwort"),
    ("motivieren", "anspornen, ermutigen", "Fremdwort"),
    ("inspirieren", "anregen", "Fremdwort"),
    ("frustrieren", "enttäuschen", "Fremdwort"),
    ("irritieren", "verwirren", "Fremdwort"),
    ("dominieren", "beherrschen", "Fremdwort"),
    ("eliminieren", "entfernen, beseitigen", "Fremdwort"),
    ("reduzieren", "verringern, weniger machen", "Fremdwort"),
    ("regulieren", "regeln, steuern", "Fremdwort"),
    ("stimulieren", "anregen", "Fremdwort"),
    ("simulieren", "nachahmen", "Fremdwort"),
    ("methodologie", "Vorgehensweise", "Fachsprache"),
    ("infrastruktur", "Grundausstattung", "Fachsprache"),
    ("kapazität", "Fähigkeit, Möglichkeit", "Fachsprache"),
    ("kompetenz", "Fähigkeit, Können", "Fachsprache"),
    ("komplexität", "Schwierigkeit", "Fachsprache"),
    ("effizienz", "Wirksamkeit", "Fachsprache"),
    ("effektivität", "Wirksamkeit", "Fachsprache"),
    ("transparenz", "Offenheit, Klarheit", "Fachsprache"),
    ("flexibilität", "Anpassungsfähigkeit", "Fachsprache"),
    ("stabilität", "Festigkeit, Beständigkeit", "Fachsprache"),
    ("priorität", "Wichtigkeit, Vorrang", "Fachsprache"),
    ("qualität", "Güte", "Fachsprache"),
    ("quantität", "Menge", "Fachsprache"),
    ("kontinuität", "Fortdauer", "Fachsprache"),
    ("intensität", "Stärke", "Fachsprache"),
    ("aktivität", "Tätigkeit", "Fachsprache"),
    ("produktivität", "Leistung", "Fachsprache"),
    ("kreativität", "Einfallsreichtum", "Fachsprache"),
    ("objektivität", "Sachlichkeit", "Fachsprache"),
    ("subjektivität", "persönliche Sicht", "Fachsprache"),
    ("realität", "Wirklichkeit", "Fachsprache"),
    ("potenzial", "Möglichkeit", "Fachsprache"),
    ("ressource", "Mittel, Vorrat", "Fachsprache"),
    ("strategie", "Plan, Vorgehen", "Fachsprache"),
    ("perspektive", "Blickwinkel, Sicht", "Fachsprache"),
    ("dimension", "Ausmaß, Größe", "Fachsprache"),
    ("konsequenz", "Folge", "Fachsprache"),
    ("tendenz", "Richtung, Neigung", "Fachsprache"),
    ("frequenz", "Häufigkeit", "Fachsprache"),
    ("relevanz", "Wichtigkeit, Bedeutung", "Fachsprache"),
    ("präsenz", "Anwesenheit", "Fachsprache"),
    ("evidenz", "Beweis, Nachweis", "Fachsprache"),
    ("kompetent", "fähig, können", "Fachsprache"),
    ("effizient", "wirksam, gut", "Fachsprache"),
    ("effektiv", "wirksam", "Fachsprache"),
    ("relevant", "wichtig, bedeutsam", "Fachsprache"),
    ("signifikant", "bedeutsam, wichtig", "Fachsprache"),
    ("adäquat", "angemessen, passend", "Fachsprache"),
    ("optimal", "bestmöglich", "Fachsprache"),
    ("essenziell", "wichtig, wesentlich", "Fachsprache"),
    ("fundamental", "grundlegend", "Fachsprache"),
    ("elementar", "grundlegend, einfach", "Fachsprache"),
    ("substanziell", "wesentlich", "Fachsprache"),
    ("potenziell", "möglich", "Fachsprache"),
    ("partiell", "teilweise", "Fachsprache"),
    ("individuell", "einzeln, persönlich", "Fachsprache"),
    ("kollektiv", "gemeinsam, zusammen", "Fachsprache"),
    ("kontinuierlich", "fortlaufend, ständig", "Fachsprache"),
    ("sukzessive", "nach und nach", "Fachsprache"),
    ("simultan", "gleichzeitig", "Fachsprache"),
    ("parallel", "gleichzeitig, nebeneinander", "Fachsprache"),
    ("konträr", "gegensätzlich", "Fachsprache"),
    ("analog", "ähnlich, entsprechend", "Fachsprache"),
    ("konkret", "genau, bestimmt", "Fachsprache"),
    ("abstrakt", "nicht greifbar", "Fachsprache"),
    ("explizit", "ausdrücklich, klar", "Fachsprache"),
    ("implizit", "nicht direkt gesagt", "Fachsprache"),
)
SIMPLE_WORDS = tuple(
    """
    der die das ein eine einer einem einen dieser diese dieses jeder jede jedes kein keine keiner keinem keinen mein meine dein deine sein seine ihr
    ihre unser unsere euer eure ich du er sie es wir mich dich sich uns euch mir dir ihm ihnen man jemand niemand alle alles haus zimmer tisch stuhl
    bett tür fenster auto bus zug fahrrad straße weg wasser brot essen trinken mann frau kind mensch leute familie freund freundin mutter vater eltern
    arzt schule arbeit geld zeit tag nacht stadt land ort platz hund katze tier baum blume buch brief bild telefon computer haben werden können müssen
    sollen wollen dürfen machen tun gehen kommen fahren laufen sagen sprechen fragen antworten erzählen sehen hören fühlen denken wissen verstehen
    geben nehmen bringen holen legen stellen setzen kaufen verkaufen bezahlen kosten arbeiten lernen lesen schreiben spielen schlafen wohnen leben
    helfen brauchen suchen finden beginnen anfangen aufhören enden öffnen schließen warten gut schlecht schön hässlich groß klein lang kurz hoch tief
    neu alt jung schnell langsam früh spät viel viele wenig wenige mehr weniger wichtig richtig falsch einfach schwer leicht schwierig warm kalt heiß
    hell dunkel laut leise nah weit nächste letzte erste hier dort da wo wohin woher jetzt heute morgen gestern bald später immer nie oft manchmal
    selten sehr ganz ziemlich etwas fast auch noch schon nur erst ja nein nicht vielleicht warum weil deshalb darum in an auf unter über vor hinter
    neben zwischen mit ohne für gegen um durch von zu nach bei aus seit bis und oder aber sondern denn wenn als ob dass obwohl eins zwei drei vier
    fünf sechs sieben acht neun zehn hundert tausend million
    """.split()
)
# --- complexity of words; fixed values
COMPLEX_SUFFIXES = ("tion", "sion", "ment", "ismus", "ität", "enz", "anz", "ieren", "ierung", "ik", "ie", "ur", "or", "är")
COMPLEX_PREFIXES = ("pre", "pro", "anti", "inter", "trans", "multi", "super", "sub", "ex", "re", "de", "dis", "un", "in")

# --- sentence length; fixed values
NOMINAL_SUFFIXES = ("ung", "heit", "keit", "tion")
SUBORDINATORS = ("weil", "dass", "wenn", "obwohl", "damit", "nachdem", "bevor", "während", "falls", "sofern")
MODAL_FORMS = (
    "kann", "kannst", "können", "könnt", "konnte", "konnten", "muss", "musst", "müssen", "müsst", "musste", "mussten", "soll", "sollst", "sollen",
    "sollt", "sollte", "sollten", "will", "willst", "wollen", "wollt", "wollte", "wollten", "darf", "darfst", "dürfen", "dürft", "durfte", "durften",
    "mag", "magst", "mögen", "mögt", "mochte", "mochten",
)
WERDEN_FORMS = ("werde", "wirst", "wird", "werden", "werdet", "wurde", "wurdest", "wurden", "wurdet", "worden")

# --- negation; fixed values
NEG_PARTICLES = ("nicht",)
NEG_ADVERBS = ("nie", "niemals", "nirgends", "nirgendwo", "nirgendwohin", "keineswegs", "keinesfalls")
NEG_PRONOUNS = ("nichts", "niemand", "niemanden", "niemandem")
NEG_DETERMINERS = ("kein", "keine", "keinen", "keinem", "keiner", "keines")
NEG_STOPLIST = (
    "unfall", "unruhe", "union", "unikum", "universum", "unschuld", "unterricht", "unternehmen", "unter", "unten", "universität", "uniform", "unbill",
    "unke", "unze", "mission", "missionar", "mister", "mistel", "mist",
)

# --- abbreviations that name a title or are common, written with a period; fixed values
TITLE_ABBREVIATIONS = (
    "Dr", "Prof", "Ing", "Mag", "Dipl", "Med", "hc", "Mr", "Mrs", "Ms", "ggf", "bzw", "ca", "usw", "bspw", "sog", "evtl", "vgl", "z", "ebd", "o", "u",
    "zzgl",
)

# --- characters that plain language allows; fixed values
ALLOWED_MARKS = ".?!:·•"
ALLOWED_QUOTES = "“”„‚‘’»«›‹"
TECHNICAL = " \t\n\r ​‌‍﻿"
MAX_COMMAS = 2

# --- subjunctive forms of closed classes, and pronouns
SUBJUNCTIVE_FORMS = (
    "wäre", "wärst", "wären", "wärt", "hätte", "hättest", "hätten", "hättet", "würde", "würdest", "würden", "würdet", "könnte", "könntest", "könnten",
    "könntet", "müsste", "müsstest", "müssten", "müsstet", "dürfte", "dürftest", "dürften", "dürftet", "möchte", "möchtest", "möchten", "möchtet",
    "sei", "seist", "seien", "seiet", "habe", "gäbe", "käme", "ginge", "bliebe",
    "waere", "waerst", "waeren", "waert", "haette", "haettest", "haetten", "haettet", "wuerde", "wuerdest", "wuerden", "wuerdet", "koennte",
    "koenntest", "koennten", "koenntet", "muesste", "muesstest", "muessten", "muesstet", "duerfte", "duerftest", "duerften", "duerftet", "moechte",
    "moechtest", "moechten", "moechtet", "gaebe", "kaeme",
)
THIRD_PERSON = ("er", "sie", "es", "ihn", "ihm", "ihr", "ihnen", "sein", "seine", "seinen", "seinem", "seiner", "ihre", "ihren", "ihrem", "ihrer")
PERSONAL_PRONOUNS = (
    "ich", "du", "er", "sie", "es", "wir", "ihr", "mich", "dich", "ihn", "uns", "euch", "mir", "dir", "ihm", "ihnen", "sich", "man",
)
MORE_SUBORDINATORS = ("ob", "da", "als", "bis", "seit", "seitdem", "indem", "sodass", "solange", "sobald", "ehe", "zumal", "obgleich", "wenngleich", "obschon")
SUBJECT_PRONOUNS = ("ich", "du", "er", "sie", "es", "wir", "ihr")
SHORT_FORMS = ("Tel", "Nr", "Str", "Abs", "Art", "Abb", "Std", "Min", "Sek", "Mio", "Mrd", "St", "Co")
INTERROGATIVES = ("wer", "was", "wen", "wem", "wo", "wohin", "woher", "wie", "warum", "weshalb", "wann", "womit", "wofür", "worauf", "woran")
RELATIVE_PRONOUNS = ("der", "die", "das", "den", "dem", "dessen", "deren", "welche", "welcher", "welches", "welchen", "welchem")
GENITIVE_PREPOSITIONS = ("wegen", "trotz", "innerhalb", "außerhalb", "während", "statt", "anstatt", "aufgrund", "hinsichtlich", "angesichts")

# --- figurative expressions: (phrase, meaning, difficulty); fixed values
FIGURATIVE = (
    ("unter vier augen", "allein sprechen", 0.6),
    ("mit offenen karten spielen", "ehrlich sein", 0.7),
    ("aus dem stegreif", "spontan", 0.8),
    ("ins schwarze treffen", "genau richtig sein", 0.7),
    ("auf nummer sicher gehen", "vorsichtig sein", 0.6),
    ("grünes licht geben", "erlauben", 0.5),
    ("hinter verschlossenen türen", "geheim", 0.7),
    ("über nacht", "plötzlich", 0.4),
    ("inflationär beschwören", "immer wieder sagen", 0.8),
    ("als postfaktisch charakterisiert", "als Zeit nach der Wahrheit beschrieben", 0.9),
    ("paralysieren lassen", "lähmen lassen", 0.7),
    ("fähnlein in den wind hängen", "schnell die Meinung ändern", 0.9),
)
# --- idioms: (phrase, meaning, difficulty, category); fixed values
IDIOMS = (
    ("die flinte ins korn werfen", "aufgeben", 0.9, "aufgeben"),
    ("ins gras beißen", "sterben", 0.8, "tod"),
    ("den löffel abgeben", "sterben", 0.8, "tod"),
    ("über den berg sein", "das Schlimmste überstanden haben", 0.7, "erfolg"),
    ("auf wolke sieben schweben", "sehr glücklich sein", 0.8, "gefühl"),
    ("eine sache auf eis legen", "etwas verschieben", 0.7, "verzögern"),
    ("das handtuch werfen", "aufgeben", 0.8, "aufgeben"),
    ("die katze aus dem sack lassen", "ein Geheimnis verraten", 0.9, "enthüllen"),
    ("den nagel auf den kopf treffen", "genau richtig liegen", 0.8, "korrektheit"),
    ("jemandem einen bären aufbinden", "jemanden anlügen", 0.9, "lügen"),
    ("die ohren steif halten", "nicht aufgeben", 0.8, "durchhalten"),
    ("auf dem holzweg sein", "falsch liegen", 0.7, "irrtum"),
    ("den mund zu voll nehmen", "übertreiben", 0.7, "übertreibung"),
    ("butter bei die fische geben", "zur Sache kommen", 0.9, "direktheit"),
    ("zwei fliegen mit einer klappe schlagen", "zwei Probleme auf einmal lösen", 0.8, "effizienz"),
    ("aus einer mücke einen elefanten machen", "etwas übertreiben", 0.8, "übertreibung"),
    ("ins fettnäpfchen treten", "sich blamieren", 0.8, "fehler"),
    ("auf dem schlauch stehen", "etwas nicht verstehen", 0.7, "verständnis"),
    ("die nase voll haben", "genug haben", 0.6, "überdruss"),
    ("den kopf in den sand stecken", "Probleme ignorieren", 0.8, "vermeidung"),
    ("mit dem kopf durch die wand wollen", "zu stur sein", 0.8, "sturheit"),
    ("die spreu vom weizen trennen", "das Wichtige vom Unwichtigen unterscheiden", 0.9, "unterscheidung"),
    ("das kind mit dem bade ausschütten", "etwas Gutes zusammen mit etwas Schlechtem wegwerfen", 0.9, "übertreibung"),
    ("das fähnlein in den wind hängen", "seine Meinung schnell ändern", 0.9, "opportunismus"),
    ("über den tellerrand blicken", "über das Gewohnte hinaus denken", 0.8, "perspektive"),
    ("auf herz und nieren prüfen", "sehr gründlich untersuchen", 0.8, "prüfung"),
    ("im sande verlaufen", "erfolglos beenden", 0.7, "scheitern"),
    ("das ist ein klacks", "das ist einfach", 0.6, "einfach"),
    ("einen dämpfer bekommen", "enttäuscht werden", 0.7, "gefühl"),
    ("sich aus dem staub machen", "heimlich weggehen", 0.8, "gehen"),
    ("den vogel abschießen", "am besten sein", 0.8, "erfolg"),
    ("den ton angeben", "bestimmen, was passiert", 0.8, "macht"),
    ("jemanden durch den kakao ziehen", "jemanden verspotten", 0.9, "spott"),
    ("ein heißes eisen", "ein heikles Thema", 0.8, "konflikt"),
    ("unter den teppich kehren", "verbergen", 0.8, "verbergen"),
    ("kalte füße bekommen", "Angst bekommen", 0.8, "gefühl"),
    ("öl ins feuer gießen", "den Streit verschlimmern", 0.8, "konflikt"),
    ("die rechnung ohne den wirt machen", "etwas falsch einschätzen", 0.9, "fehler"),
    ("etwas aus dem ärmel schütteln", "etwas schnell und leicht machen", 0.8, "einfach"),
    ("auf die pauke hauen", "laut feiern", 0.8, "feiern"),
    ("mit allen wassern gewaschen", "sehr erfahren", 0.9, "erfahrung"),
    ("die kirche im dorf lassen", "nicht übertreiben", 0.8, "maß"),
    ("am ball bleiben", "weiter aktiv bleiben", 0.7, "beharrlichkeit"),
    ("jemanden auf den arm nehmen", "jemanden zum Spaß ärgern", 0.8, "spott"),
    ("aus allen wolken fallen", "sehr überrascht sein", 0.8, "überraschung"),
    ("auf des messers schneide stehen", "sehr unsicher sein", 0.9, "unsicher"),
    ("in den sauren apfel beißen", "eine unangenehme Sache erledigen", 0.8, "unangenehm"),
    ("zwischen den zeilen lesen", "die versteckte Bedeutung erkennen", 0.8, "verstehen"),
    ("in saus und braus leben", "sehr aufwendig leben", 0.9, "leben"),
    ("ein auge zudrücken", "etwas nicht streng bestrafen", 0.7, "nachsicht"),
    ("das blaue vom himmel versprechen", "unmögliche Dinge versprechen", 0.9, "lügen"),
    ("sich etwas aus den fingern saugen", "etwas erfinden", 0.8, "lügen"),
    ("jemanden auf die palme bringen", "jemanden wütend machen", 0.8, "wut"),
    ("jemandem reinen wein einschenken", "die Wahrheit sagen", 0.9, "wahrheit"),
    ("klar schiff machen", "aufräumen und Ordnung schaffen", 0.8, "ordnung"),
    ("von der stange", "nicht besonders", 0.7, "qualität"),
)
#: In a sentence of more than 15 words an idiom is harder by 0.2, beside one of these words by 0.3.
IDIOM_CONTEXT = ("jedoch", "dennoch", "allerdings", "freilich")
#: Animals, of which two words of a sentence make an idiom likelier; words of a phrase that stand for any word.
ANIMALS = ("hund", "katze", "maus", "schwein", "vogel")
PLACEHOLDERS = ("jemand", "jemandem", "jemanden", "jemandes", "etwas")
LITERAL_MARKERS = ("wirklich", "tatsächlich", "buchstäblich", "echt", "konkret")

# --- metaphors in a sentence in lower case; parts of the body with verbs, unless one is ill; fixed values
METAPHORS = (
    r"\b(herz|kopf|hand|auge|ohr)\s+(ist|war|wird)\s+\w+",
    r"\b(stein|berg|wolke|himmel|erde)\s+(fällt|steigt|sinkt)",
    r"\b(feuer|wasser|luft|wind)\s+(brennt|fließt|weht)",
    r"\b(türe?n?|fenster|brücke)\s+(öffnen|schließen|bauen)",
    r"\b(spreu|weizen)\s+(vom|trennen)",
    r"\b(kind)\s+(mit\s+dem\s+bade?)\s+(ausschütten)",
    r"\b(tellerrand)\s+(blicken|schauen)",
    r"\b(fähnlein)\s+(in\s+den\s+wind)\s+(hängen)",
    r"\b(herz\s+und\s+nieren)\s+(prüfen)",
    r"\b(sande?)\s+(verlaufen)",
    r"\b(lippenbekenntnisse|lippenbekenntnis)",
    r"\b(mammutaufgabe)",
    r"\b(mosaiksteine?)",
)
BODY_PART_VERBS = (
    ("kopf", ("zerbrechen", "rauchen", "platzen", "schwirren")),
    ("herz", ("bluten", "brennen", "schlagen", "zerreißen")),
    ("hand", ("brennen", "jucken", "zittern", "binden")),
    ("auge", ("tränen", "brennen", "stechen", "zudrücken")),
    ("nase", ("bluten", "jucken", "rümpfen", "voll haben")),
)
ILL = ("krank", "schmerz", "verletzt")

# --- known synonyms: (word, recommendation, synonyms); fixed values
SYNONYMS = (
    ("automobil", "Auto", ("fahrzeug", "auto", "wagen", "kfz")),
    ("fahrzeug", "Auto", ("auto", "wagen", "kfz", "pkw")),
    ("office", "Büro", ("büro", "arbeitsplatz")),
    ("konzern", "Firma", ("unternehmen", "firma", "betrieb")),
    ("immobilie", "Haus", ("gebäude", "haus", "objekt")),
    ("individuum", "Person", ("person", "mensch", "bürger")),
    ("kapital", "Geld", ("geld", "finanzen", "mittel")),
    ("tätigkeit", "Arbeit", ("arbeit", "job", "beruf")),
    ("residenz", "Wohnung", ("wohnung", "heim", "zuhause")),
    ("kommunikation", "Gespräch", ("gespräch", "unterhaltung", "diskussion")),
    ("information", "Nachricht", ("nachricht", "mitteilung", "auskunft")),
    ("analyse", "Prüfung", ("untersuchung", "prüfung", "bewertung")),
    ("implementierung", "Umsetzung", ("umsetzung", "realisierung", "durchführung")),
    ("optimierung", "Verbesserung", ("verbesserung", "perfektionierung")),
)

# --- weight of each rule (lower: more important), cost of a weight; fixed values
RULE_WEIGHTS = {
    "nebensaetze": 0, "satzlaenge": 0, "passiv_erkennung": 0, "fremdwoerter": 0, "perplexity_saetze": 0,
    "komposita": 10, "abkuerzungen": 10, "genitiv": 10, "konjunktiv": 10, "negationen": 10, "komplexitaet": 10, "personalpronomen": 10,
    "kurze_woerter": 20, "redewendungen": 20, "zahlwoerter": 20, "interpunktion": 20, "synonyme": 20, "mehrere_aussagen": 20,
}
DEFAULT_WEIGHT = 15
VIOLATION_COST = {0: 3, 10: 2, 20: 1}
DEFAULT_COST = 1

# --- readability: (raw value, score) of each measure; fixed values
KNOTS = {
    "amstad": ((0, 0), (20, 2), (40, 4), (60, 6), (70, 7), (80, 8), (90, 9), (100, 10)),
    "wiener": ((15, 0), (12, 2), (10, 4), (8, 6), (6, 7), (4, 8), (2, 9), (0, 10)),
    "smog": ((18, 0), (15, 2), (12, 4), (9, 6), (7, 7), (5, 8), (3, 9), (1, 10)),
    "lix": ((70, 0), (60, 2), (50, 4), (40, 6), (35, 7), (30, 8), (25, 9), (20, 10)),
    "asl": ((25, 0), (20, 3), (15, 5), (10, 7), (8, 8), (6, 9), (4, 10)),
    "asw": ((3.0, 0), (2.5, 3), (2.0, 5), (1.8, 7), (1.5, 8), (1.3, 9), (1.0, 10)),
    "pct_long": ((50, 0), (40, 3), (30, 5), (20, 7), (15, 8), (10, 9), (5, 10)),
    "pct_poly": ((40, 0), (30, 3), (20, 5), (15, 7), (10, 8), (5, 9), (0, 10)),
    "pct_mono": ((10, 0), (20, 3), (30, 5), (40, 7), (50, 8), (60, 9), (80, 10)),
}
RATINGS = ((5, "expert"), (10, "complex"), (15, "readable"), (16, "plain"), (18, "simple"), (None, "easy"))


# --- number words; fixed values
#: Number words and their inflections; one, eight and eleven are ambiguous and left out.
NUMBER_WORDS = tuple(
    """
    null
    zwei zweier zweien zweite zweiten zweiter zweites zweimal zweitens
    drei dreier dreien dritte dritten dritter drittes dreimal drittens
    vier vierer vieren vierte vierten vierter viertes viermal viertens
    fünf fünfer fünfen fünfte fünften fünfter fünftes fünfmal fünftens
    sechs sechser sechsen sechste sechsten sechster sechstes sechsmal sechstens
    sieben siebener siebenen siebte siebten siebter siebtes siebenmal siebtens
    neun neuner neunen neunte neunten neunter neuntes neunmal neuntens
    zehn zehner zehnen zehnte zehnten zehnter zehntes zehnmal zehntens
    zwölf zwölfte zwölften zwölfter zwölftes zwölfmal
    dreizehn dreizehnte dreizehnten dreizehnter dreizehntes
    vierzehn vierzehnte vierzehnten vierzehnter vierzehntes
    fünfzehn fünfzehnte fünfzehnten fünfzehnter fünfzehntes
    sechzehn sechzehnte sechzehnten sechzehnter sechzehntes
    siebzehn siebzehnte siebzehnten siebzehnter siebzehntes
    achtzehn achtzehnte achtzehnten achtzehnter achtzehntes
    neunzehn neunzehnte neunzehnten neunzehnter neunzehntes
    zwanzig zwanzigste zwanzigsten zwanzigster zwanzigstes
    einundzwanzig einundzwanzigste einundzwanzigsten einundzwanzigster einundzwanzigstes
    zweiundzwanzig zweiundzwanzigste zweiundzwanzigsten zweiundzwanzigster zweiundzwanzigstes
    dreiundzwanzig dreiundzwanzigste dreiundzwanzigsten dreiundzwanzigster dreiundzwanzigstes
    vierundzwanzig vierundzwanzigste vierundzwanzigsten vierundzwanzigster vierundzwanzigstes
    fünfundzwanzig fünfundzwanzigste fünfundzwanzigsten fünfundzwanzigster fünfundzwanzigstes
    sechsundzwanzig sechsundzwanzigste sechsundzwanzigsten sechsundzwanzigster sechsundzwanzigstes
    siebenundzwanzig siebenundzwanzigste siebenundzwanzigsten siebenundzwanzigster siebenundzwanzigstes
    achtundzwanzig achtundzwanzigste achtundzwanzigsten achtundzwanzigster achtundzwanzigstes
    neunundzwanzig neunundzwanzigste neunundzwanzigsten neunundzwanzigster neunundzwanzigstes
    dreißig dreißigste dreißigsten dreißigster dreißigstes
    einunddreißig einunddreißigste einunddreißigsten einunddreißigster einunddreißigstes
    zweiunddreißig zweiunddreißigste zweiunddreißigsten zweiunddreißigster zweiunddreißigstes
    dreiunddreißig dreiunddreißigste dreiunddreißigsten dreiunddreißigster dreiunddreißigstes
    vierunddreißig vierunddreißigste vierunddreißigsten vierunddreißigster vierunddreißigstes
    fünfunddreißig fünfunddreißigste fünfunddreißigsten fünfunddreißigster fünfunddreißigstes
    sechsunddreißig sechsunddreißigste sechsunddreißigsten sechsunddreißigster sechsunddreißigstes
    siebenunddreißig siebenunddreißigste siebenunddreißigsten siebenunddreißigster siebenunddreißigstes
    achtunddreißig achtunddreißigste achtunddreißigsten achtunddreißigster achtunddreißigstes
    neununddreißig neununddreißigste neununddreißigsten neununddreißigster neununddreißigstes
    vierzig vierzigste vierzigsten vierzigster vierzigstes
    einundvierzig einundvierzigste einundvierzigsten einundvierzigster einundvierzigstes
    zweiundvierzig zweiundvierzigste zweiundvierzigsten zweiundvierzigster zweiundvierzigstes
    dreiundvierzig dreiundvierzigste dreiundvierzigsten dreiundvierzigster dreiundvierzigstes
    vierundvierzig vierundvierzigste vierundvierzigsten vierundvierzigster vierundvierzigstes
    fünfundvierzig fünfundvierzigste fünfundvierzigsten fünfundvierzigster fünfundvierzigstes
    sechsundvierzig sechsundvierzigste sechsundvierzigsten sechsundvierzigster sechsundvierzigstes
    siebenundvierzig siebenundvierzigste siebenundvierzigsten siebenundvierzigster siebenundvierzigstes
    achtundvierzig achtundvierzigste achtundvierzigsten achtundvierzigster achtundvierzigstes
    neunundvierzig neunundvierzigste neunundvierzigsten neunundvierzigster neunundvierzigstes
    fünfzig fünfzigste fünfzigsten fünfzigster fünfzigstes
    sechzig sechzigste sechzigsten sechzigster
    siebzig siebzigste siebzigsten siebzigster
    achtzig achtzigste achtzigsten achtzigster
    neunzig neunzigste neunzigsten neunzigster
    hundert hunderte hundertste hundertsten hundertster
    tausend tausende tausendste tausendsten tausendster
    million millionen millionste millionsten millionster
    milliarde milliarden milliardste milliardsten
    hälfte hälften drittel drittels viertel viertels fünftel fünftels sechstel sechstels siebtel siebtels achtel achtels neuntel neuntels zehntel zehntels zwanzigstel zwanzigstels hundertstel hundertstels
    """.split()
)
ROMAN = "^(X{1,3}|IX|IV|V?I{1,3})$"
NUMBERS_TO_100 = "^((ein|zwei|drei|vier|fünf|sechs|sieben|acht|neun)und(fünfzig|sechzig|siebzig|achtzig|neunzig)|einhundert)$"

# --- suggestions in messages, placeholders of lazy rewrites; fixed values
SUGGESTION_PATTERNS = ('Einfacher: "([^"]+)"', 'Besser: "([^"]+)"', 'Alternative: "([^"]+)"', 'Richtig: "([^"]+)"', 'Ersetzen durch: "([^"]+)"')
LAZY_PATTERNS = (r"\[\s*\.{2,}\s*\]", r"\(\s*\.{2,}\s*\)", r"(?i)\b(unveraendert|unverändert)\b", r"(?i)\bRest\s+(bleibt|ist)\s+gleich\b", r"(?i)\bwie\s+oben\b", r"(?i)\bsiehe\s+oben\b")
MIN_LENGTH_RATIO, MIN_SIMILARITY = 0.4, 0.15
EASY_RULES = ("passiv_erkennung", "nebensaetze", "genitiv", "konjunktiv", "negationen", "abkuerzungen")
HARD_RULES = ("perplexity_saetze", "komplexitaet", "mehrere_aussagen")
CONTENT_RULES = ("fremdwoerter", "komposita", "abkuerzungen", "kurze_woerter", "komplexitaet", "redewendungen", "synonyme")
FALLBACK_INSTRUCTIONS = {
    "satzlaenge": 'Teile den Satz mit "{word}..." in 2-3 kurze Sätze',
    "perplexity_saetze": 'Vereinfache die Struktur des Satzes mit "{word}..."',
    "nebensaetze": "Entferne den Nebensatz. Mache zwei Hauptsätze daraus.",
    "passiv_erkennung": 'Schreibe "{word}" im Aktiv. Wer tut was?',
    "komplexitaet": 'Ersetze "{word}" durch ein einfacheres Wort',
    "fremdwoerter": 'Ersetze das Fremdwort "{word}" durch ein deutsches Wort',
    "komposita": 'Trenne "{word}" mit Bindestrich oder verwende einfachere Wörter',
    "abkuerzungen": 'Schreibe "{word}" aus',
    "negationen": 'Formuliere "{word}" positiv statt negativ',
    "kurze_woerter": '"{word}" ist zu lang. Verwende ein kürzeres Wort oder trenne es',
    "genitiv": 'Vermeide Genitiv bei "{word}". Verwende "von" oder formuliere um',
    "konjunktiv": 'Verwende bei "{word}" normale Verbform statt Konjunktiv',
}
# --- replacements of the corpus cleaner, in this order; fixed values
NORMALIZATION = (("ß", "ss"), ("„", '"'), ("“", '"'), ("–", "-"), ("—", "-"), ("…", "..."), ("´", "'"), ("`", "'"), ("‘", "'"), ("’", "'"))
ARTIFACT = r"-- _ \$\$\(.*?\)"
