"""Sentences written by hand, apart from the grammar that the judge learns from.  ``[[kind:span]]`` marks personal data that the base patterns don't find."""

CASES = """
Bitte wenden Sie sich an [[email:anna.huber (at) gemeinde-sonnfeld.de]] oder an die Zentrale.
Rückfragen: [[email:vorstand [at] turnverein-lind [punkt] de]], Antwort binnen zwei Tagen.
Unsere Redaktion erreichen Sie unter [[email:leserbriefe(at)blatt-am-see.ch]].
Telefonisch sind wir unter [[phone:08031 / 445 210]] von acht bis zwölf erreichbar.
Handy: [[phone:0171 2345678]], bitte erst nach 18 Uhr.
Fax [[phone:(089) 5544-3322]], Stichwort Hofladen.
Écrivez à [[email:claire.morel [at] mairie-valbonne.fr]] avant le 3 mai.
Contact : [[email:bureau arobase asso-jardins point org]] pour toute question.
Téléphone : [[phone:01 42 68 53 00]], du lundi au vendredi.
Appelez Luc au [[phone:06-12-34-56-78]] pour le covoiturage.
Escriba a [[email:secretaria arroba colegiosur punto es]] con sus datos.
Teléfono de contacto: [[phone:91 555 12 34]], horario de mañana.
Llame al [[phone:(55) 5123-4567]] para reservar mesa.
Reach Tom at [[email:tom.baker at millhouse dot co]] for the keys.
My address is [[email:j_ferris99 @ oldmail.net]] these days.
You can mail [[email:sales {at} northpier {dot} com]] for a quote.
Ping [[email:k.osei(at)studio-nine(dot)org]] about the prints.
Phone me on [[phone:020 7946 0958]] after lunch.
Office tel. [[phone:(415) 555-0132]], ask for Dana.
Call [[phone:555-867-5309]] and leave a message.
WhatsApp [[phone:0044 7700 900123]] works best.
Mobile [[phone:07700 900 461]], landline to follow.
She paid with Visa [[card:4539/5787/6362/1486]] last week.
Card on file [[card:5425.2334.3010.9903]], expires in May.
Kreditkarte [[card:4716  1089  9971  6531]] wurde belastet.
Carte bancaire [[card:4485.2753.5612.0349]] refusée au guichet.
Tarjeta [[card:5500/0000/0000/0004]] a nombre de M. Ruiz.
Login came from [[ip:2001:0db8:85a3:0000:0000:8a2e:0370:7334]] at night.
The host [[ip:2001:db8::ff00:42:8329]] answered slowly.
Server [[ip:fe80::1ff:fe23:4567:890a]] wurde neu gestartet.
Adresse IP [[ip:2a01:e34:ec2a:94a0::5]] bloquée.
The parcel weighs 4 200 300 grams on paper, which is a typo.
We met at noon. At two we left.
They arrived at Rue Verte. point final.
Look at page 12.45 for the chart.
Sold 12 @ 3.50 each, 14 @ 2.75 each.
ISBN 978-3-16-148410-0 is out of print.
Order 20240517-0042 shipped on 2024-05-19.
Version 10.4.2 of the tool, build 20231105.
The ratio was 3:2:1 and later 12:30:45.
In C++ write std::vector or a::b for names.
Meeting 10:30:00 to 11:45:00, room 4.
Rechnung Nr. 4471 1203 9987 vom 12.03.2024.
Umsatz 1.234.567 Euro, Vorjahr 1.198.400 Euro.
Flurstück 1123/4, Grundbuch Blatt 20456.
Le total est de 12 500 000 euros pour 2019.
Référence 2023/118/0045 du dossier.
La población era de 1 204 560 habitantes en 2011.
Expediente 2021-00457-B, folio 118.
Coordinates 48.137154 11.576124 mark the square.
The years 1914 1918 1939 1945 are on the stone.
Scores were 21 19 15 21 11 across five sets.
He is good at maths and at chess.
Serial 0012 9981 4456 7781 2210 on the back.
Between 1000 and 2000 people came, maybe 1500.
DOI 10.1000/182 and PMID 12345678 are cited.
Train 4711 leaves at 08.15 from track 12.
Set aside 30.000 to 40.000 per year until 2030.
The tag is dead::beef in the config of the game.
Er wohnt at home sozusagen. Punkt.
""".strip().split("\n")
