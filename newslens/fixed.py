"""Fixed values that must equal the analysed application's for the same results.

Everything in the block below is data, stated as it runs there (three of the
snippets are two adjacent literals joined by the Python parser, which is why
the list has 80 entries). Each list is only a default: every operator that
uses one takes it as a parameter.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the analysed application; keep order as given)
# ---------------------------------------------------------------------------

# Political leanings in display order and the sentiment label domain.
LEANINGS = ("links", "mitte_links", "mitte", "mitte_rechts", "rechts")
SENTIMENTS = ("negative", "neutral", "positive")
SENTIMENT_SCORES = {"positive": 1, "neutral": 0, "negative": -1}
# Leanings shown in the sentiment-score trend.
TREND_LEANINGS = ("links", "mitte", "rechts")

# Dashboard parameters.
MONTH_FLOOR = 202311          # first month kept on load (yyyyMM)
EXCLUDED_TOPIC = "Börse"       # topic dropped on load, nulls kept
MIN_TOPIC_ARTICLES = 50       # topic menu threshold
TOPIC_MENU_SIZE = 20          # topic menu length
BLIND_SPOT_PCT = 10           # share (percent) at or below which a leaning is a blind spot

# Cleaning parameters.
GERMAN_MIN_WORDS = 5          # at least this many marker words must occur
# A run of UTF-8 text decoded as Latin-1/cp1252; texts containing it are dropped.
MOJIBAKE_MARKER = 'Ã¼Ã¤Ã¶ÃŸâ\x82¬Ã'

# Enrichment parameters.
TOKEN_MIN_LEN = 2
TOKEN_MAX_LEN = 15
MODEL_MAX_TOKENS = 512
SENTIMENT_BATCH = 10
MIN_TOPIC_SIZE = 10
TOPIC_LABEL_CUTOFF = 0.50
TOP_ENTITIES = 10
TOP_TOPIC_WORDS = 10
RANDOM_SEED = 42

PAGE_SIZE = 2000
HEADLINES_PER_SOURCE = 100
HEADLINE_LANGUAGE = "de"
HEADLINE_WINDOW_HOURS = 24

# Hosts whose pages are read paragraph by paragraph; all others use the
# article extractor.
PARAGRAPH_HOSTS = (
    'www.tagesspiegel.de',
    'orf.at',
    'www.welt.de',
    'www.diepresse.com',
    'www.focus.de',
)

HEADLINE_SOURCES = (
    'stern.de',
    'sueddeutsche.de',
    'bild.de',
    'tagesspiegel.de',
    'faz.net',
    'express.de',
    'tagesschau.de',
    'spiegel.de',
    'morgenpost.de',
    'dw.de',
    'jungewelt.de',
    'jungefreiheit.de',
    'freitag.de',
    'taz.de',
)

GERMAN_MARKER_WORDS = (
    'und',
    'der',
    'das',
    'ist',
    'zu',
    'mit',
    'von',
    'auf',
    'für',
    'den',
    'im',
    'ein',
    'nicht',
    'eine',
    'als',
    'auch',
    'aber',
    'wie',
    'es',
    'am',
    'aus',
    'bei',
    'dass',
    'oder',
    'so',
    'wenn',
    'werden',
    'wir',
    'hat',
    'sich',
    'dem',
    'des',
    'noch',
    'nur',
    'kann',
    'um',
    'ja',
    'mehr',
)

NON_ARTICLE_SNIPPETS = (
    'Hauptnavigation: Nutzen Sie die Tabulatortaste, um durch die Menüpunkte zu navigieren. Öffnen Sie Untermenüs mit der Leertaste. Schließen Sie Untermenüs mit der Escape-Taste. Hauptnavigation: Nutzen Sie die Tabulatortaste, um durch die Menüpunkte zu navigieren. Öffnen Sie Untermenüs mit der Leertaste.',
    'Lesen Sie mehr zum Thema In anspruchsvollen Berufsfeldern im Stellenmarkt der SZ. Sie möchten die digitalen Produkte der SZ mit uns weiterentwickeln? Bewerben Sie sich jetzt!Jobs bei der SZ Digitale Medien Gutscheine:',
    'öffnet in neuem Tab oder Fenster',
    'Danke, dass Sie ZEIT ONLINE nutzen.',
    'Melden Sie sich jetzt mit Ihrem bestehenden Account an oder testen Sie unser digitales Abo mit Zugang zu allen Artikeln. Erscheinungsbild Die Zusammenfassung für diesen Artikel kann leider momentan nicht angezeigt werden.',
    'ZEIT ONLINE hat diese Meldung redaktionell nicht bearbeitet. Sie wurde automatisch von der Deutschen Presse-Agentur (dpa) übernommen.',
    'Kommentar | ',
    'Berlin (dpa/bb). ',
    'Deutschen Presse-Agentur',
    'dpa',
    '+++ ',
    'SZ-Redaktion',
    'WELT TV++',
    '© dpa-infocom, ',
    'Drucken Teilen',
    'Nicht verpassen: Alles rund ums Thema Job & Beruf finden Sie im Karriere-Newsletter unseres Partners Merkur.de.',
    'Erstellt durch: ',
    '0 Weniger als eine Minute',
    '► ',
    '▶︎© ',
    '© dpa/',
    '© REUTERS/',
    '© Getty Images',
    '© IMAGO/',
    '© imago images/',
    '© imago/',
    'Lesen Sie auch',
    '© Berliner Feuerwehr ',
    '© privat ',
    'Kopiere den aktuellen Link ',
    'DIE ZEIT: ',
    'Melden Sie sich jetzt mit Ihrem bestehenden Account an oder testen Sie unser digitales Abo mit Zugang zu allen Artikeln. Abo testen',
    '"Licht Aus" So ging es Jochen Schropp nach der Sendung Im Interview verrät Jochen Schropp, was "Licht Aus" in ihm verändert hat und was für ihn zu den schönsten Erlebnissen aus der Show zählt.',
    '"Mehr als zwei Etagen schaffe ich kaum zu Fuß" Baerbock schildert im stern Folgen ihrer Covid-Erkrankung – viele Genesungswünsche für Außenministerin',
    '(SZ) ',
    '06. November 2024: Til Schweiger postet Schwarz-Weiß-Foto von sich – Fans denken er sei tot Mit seinem neuen Posting auf Instagram wollte Til Schweiger eigentlich nur ein Update geben. Doch das Foto, welches er für seinen Instagram-Beitrag gewählt hat, sorgt unter seinen Fans für Verwunderung. Denn das Schwarz-Weiß-Bild erinnert an eine Todesanzeige. "Was ist passiert? Es soll dumm aussehen, aber solche Fotos postet man gewöhnlich nur als ein Todeszeichen im sozialen Netzwerk", schreibt ein Fan. "Ist er gestorben?", fragt ein anderer. Andere freuen sich, überhaupt mal wieder etwas von Schweiger zu erfahren. Screenshot Instagram Til Schweiger Mehr',
    '167 Millionen Aufrufe: Trailer des neuen "Joker"-Films weckt Rieseninteresse Schon ein halbes Jahr vor seinem Kinostart weckt die Fortsetzung des Thrillers "Joker" riesiges Interesse. Der Trailer von "Joker: Folie A Deux" mit Popstar Lady Gaga in einer Hauptrolle wurde innerhalb der ersten 24 Stunden nach seiner Veröffentlichung sensationelle 167 Millionen Mal angesehen, wie das Branchenmagazin "Variety" am Donnerstag (Ortszeit) berichtete. Auf der Videoplattform Youtube landete der Trailer demnach sofort an der Spitze der Trendvideos.',
    '1999 in Hamburg verschwunden Polizei sucht mysteriösen Anrufer – neue Spur im Vermisstenfall Hilal Ercan Sie ist das einzige langzeitvermisste Kind in Hamburg: 1999 verschwand die damals zehnjährige Hilal Ercan spurlos. Jetzt verfolgt die Polizei eine neue Spur.',
    'AFP/',
    'An dieser Stelle ist ein externer Inhalt eingebunden Zum Anschauen benötigen wir Ihre Zustimmung Bitte aktivieren Sie JavaScript damit Sie diesen Inhalt anzeigen können. Weiter ',
    'Andreas Klaer ',
    'Auf Diddys Jacht Neue Missbrauchsvorwürfe gegen Sänger Chris Brown In einer Doku sollen Frauen zu Wort kommen, die Chris Brown schwere Vorwürfe machen. Er wird unter anderem der Vergewaltigung beschuldigt – nicht zum ersten Mal.',
    '(dpa/tmn). ',
    'Bornschein Podcast : Bornschein trifft Henrik Falk Der Strategie- und Digitalexperte Christoph Bornschein sucht mit eingeladenen Fachleuten nach Ideen der Zukunft. Es geht oft ums Digitale, aber weit darüber hinaus. Diese Woche ist der Vorstandsvorsitzende der Berliner Verkehrsbetriebe zu Gast. Es geht um die digitale Verkehrswende. Und darum, was das überhaupt ist.',
    'Das stern-Team vor Ort informiert Sie immer samstags im kostenlosen Newsletter "Inside America" über die wichtigsten Entwicklungen und gibt Einblicke, wie Amerikanerinnen und Amerikaner wirklich auf ihr Land schauen. Hier geht es zur Registrierung. Nach Eingabe Ihrer E-Mail-Adresse erhalten Sie eine E-Mail zur Bestätigung Ihrer Anmeldung.',
    'Der F.A.Z. Podcast für Deutschland ist der tägliche Podcast der F.A.Z. zu den relevantesten Themen des Tages. Der Podcast erscheint immer um 17 Uhr, von Montag bis Freitag. Alle Folgen finden Sie hier . Sie können den Podcast ganz einfach bei Apple Podcasts, Spotify oder Deezer abonnieren und verpassen so keine neue Folge. Natürlich sind wir auch in anderen Podcast-Apps verfügbar, suchen Sie dort einfach nach „F.A.Z. Podcast für Deutschland“. Ebenfalls finden Sie uns in der FAZ.NET-App.',
    'Dieser Artikel ist Teil von ZEIT am Wochenende, ',
    'Direkt aus dem dpa-Newskanal: Dieser Text wurde automatisch von der Deutschen Presse-Agentur (dpa) übernommen und von der SZ-Redaktion nicht bearbeitet. ',
    'dpa/- ',
    'dpa/ ',
    'dpa/',
    '+ ',
    'F.A.Z. exklusiv : ',
    'Gestaltung: Tagesspiegel; Fotos: ',
    'imago images / ',
    'imago images/',
    'IMAGO/',
    'Imago/',
    'imago/',
    'Inhalt Auf einer Seite lesen Inhalt Seite 1 ',
    'Interview | ',
    'Jetzt im Livestream – ',
    'Kennen Sie schon unsere PLUS-Inhalte ? Jetzt Morgenpost testen Sie haben vermutlich einen Ad-Blocker aktiviert. Aus diesem Grund können die Funktionen des Podcast-Players eingeschränkt sein. Bitte deaktivieren Sie den Ad-Blocker, um den Podcast hören zu können.',
    'Jetzt weiterlesen Dies ist kein Abo. Ihre Registrierung ist komplett kostenlos, ohne versteckte Kosten. Gleich geschafft! Bitte bestätigen Sie Ihren Account über den Bestätigungslink in der gesendeten E-Mail',
    'Kopiere den aktuellen',
    'liveblog ',
    'Netflix entfernt interaktive Titel Was User jetzt noch sehen müssen Netflix nimmt die meisten interaktiven Filme und Serien aus dem Katalog. Was Abonnenten jetzt noch sehen müssen.',
    'News von ZDFheute on Instagram: ',
    'Ottmar Winter PNN/Ottmar Winter PNN ',
    'picture alliance / ',
    'picture alliance/dpa ',
    '(dpa/bb).',
    'rbb|24-Adventskalender | ',
    'REUTERS/',
    'Reuters/',
    'Teilen Verschenken Merken Drucken ',
    'Von: Schließen Artikelzusammenfassung Dies ist ein experimentelles Tool. Die Resultate können unvollständig, veraltet oder sogar falsch sein. ',
    'Sehen Sie im Video: ',
    'Sie können den Podcast ganz einfach bei Apple Podcasts, Spotify oder Deezer abonnieren und verpassen so keine neue Folge. Natürlich sind wir auch in anderen Podcast-Apps verfügbar, suchen Sie dort einfach nach „F.A.Z. Podcast Finanzen & Immobilien“. Ebenfalls finden Sie uns in der FAZ.NET-App. Alle unsere Podcast-Angebote finden Sie hier. Haben Sie Fragen oder Anmerkungen zum Podcast? Dann melden Sie sich gerne bei podcast@faz.de.',
    'Sie sind nun eingeloggt. Sollten Sie dennoch nicht auf gesperrte Artikel zugreifen können, löschen Sie bitte die im Browser gespeicherten Cookies und loggen Sie sich dann erneut ein. Zum Artikel: ',
)

TRIM_AFTER_PHRASES = (
    'Die WELT als ePaper: Die vollständige Ausgabe steht Ihnen bereits am Vorabend zur Verfügung – so sind Sie immer hochaktuell informiert. Weitere Informationen http://epaper.welt.de Der Kurz-Link dieses Artikels lautet:',
    'Hier können Sie interessante Artikel speichern',
    'Wiesbaden/Schwalmstadt. Nach den tödlichen Polizeischüssen in Schwalmstadt hat Innenminister Roman Poseck (CDU) den',
    'Sie wollen wissen, wie die Sterne in Liebesdingen, im Beruf und in Sachen Gesundheit für Sie stehen? ',
    'Prime Deal Days 2024: Das waren die besten Angebote Kopiere den aktuellen Link Amazon',
    'LED-Taschenlampe für 18 statt 37 Euro: Die Top-Deals am Donnerstag Amazon',
    'Kaufberatung Audi A5 - diese Schöheit ist kein Biest Wieso Audi so lange keinen echten Konkurrente',
    'Einhell Rasentrimmer heute 41 % günstiger: ',
    ' <blockquote class="instagram-media" data-instgrm-captioned data-',
    'Haben Sie den Eurojackpot geknackt?',
    'Tag für Tag gibt es Ereignisse, Anekdoten, Geburts- oder Sterbetage, an die erinnert werden soll. ',
    'Beim Lotto 6aus49 steht die Gewinnchance bei 1:140 Millionen Jeder träumt von einem 6er im Lotto ... ',
    'Berlin. Das Cashplus von Unitplus bietet aktuell 3,23 Prozent Zinsen und damit mehr als manches Tagesgeld. ',
    'Berlin. Für einen Auto-, Wohn- oder Ratenkredit der ING gelten neue Konditionen. ',
    'Berlin. Zinsstarke Angebote für ein Festgeld oder Tagesgeld werden rar. ',
    'Die Gewinnchancen beim Lotto 6aus49 stehen bei ',
    'Aktuelle Nachrichten und Hintergründe aus Politik, Wirtschaft und Sport aus Berlin, Deutschland und der Welt.',
)

ALLOWED_OUTLETS = (
    'spiegel',
    'taz',
    'jungewelt',
    'freitag',
    'zeit',
    'tagesspiegel',
    'dw',
    'tagesschau',
    'stern',
    'focus',
    'welt',
    'jungefreiheit',
    'sueddeutsche',
    'faz',
    'morgenpost',
    'bild',
    'rbb24',
    'express',
)

OUTLET_LEANING = {
    'spiegel': 'mitte_links',
    'taz': 'links',
    'jungewelt': 'links',
    'freitag': 'links',
    'zeit': 'mitte_links',
    'tagesspiegel': 'mitte_links',
    'dw': 'mitte',
    'tagesschau': 'mitte',
    'stern': 'mitte_rechts',
    'focus': 'mitte_rechts',
    'welt': 'mitte_rechts',
    'jungefreiheit': 'rechts',
    'sueddeutsche': 'mitte_links',
    'faz': 'mitte_rechts',
    'morgenpost': 'mitte_rechts',
    'bild': 'rechts',
    'rbb24': 'mitte',
    'express': 'rechts',
}

CANDIDATE_TOPIC_LABELS = (
    'Israel-Palästina-Konflikt',
    'Bundespolitik',
    'Gesundheitspolitik',
    'Migrationspolitik',
    'Bauernproteste',
    'Landespolitik - Berlin',
    'Filmfestivals',
    'Islamismus',
    'Christina Block, Kinder',
    'Präsidentschaftswahlen - USA',
    'Bundesliga',
    'Fußball - International',
    'Hochwasser - Süddeutschland',
    'Warnstreik - HHLA',
    'Cannabis - Legalisierung',
    'Gesundheit',
    'Warnstreiks',
    'China (Außenpolitik)',
    'Terrorismus',
    'Sexualität',
    'Warnstreiks - GDL',
    'Ampel-Regierung',
    'Migrationspolitik',
    'Antisemitismus',
    'Volkswagen',
    'Handball-EM',
    'Kunst und Kultur',
    'Wirtschaftspolitik',
    'Gebäudeeinsturz - Mallorca',
    'COVID-19',
    'Nato - Donald Trump',
    'Ukraine-Krieg',
    'Klimawandel',
    'Protest',
    'Gendern',
    'Bundesregierung',
    'Politik',
    'Scholz',
    'Habeck',
    'Lindner',
    'Kultur',
    'Wirtschaft',
    'VW',
    'Streik',
    'Inflation',
    'Extreme Wetterereignisse',
    'KI',
    'Iran',
    'Umweltkatastrophen',
    'China-Taiwan',
    'Energiekrise',
    'Bundestagswahl',
    'Digitalisierung',
    'Migrationskrise',
    'Olympische Spiele',
    'Fußball-EM',
)

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------

# Candidate labels as used for scoring: the list holds one label twice.
DISTINCT_TOPIC_LABELS = tuple(dict.fromkeys(CANDIDATE_TOPIC_LABELS))
