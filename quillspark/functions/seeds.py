"""Short texts of our own in each language that detection knows; profiles are counted from them."""

SEEDS = {
    "de": """
Ich habe dieses Produkt vor einer Woche bestellt und bin sehr zufrieden damit. Die Lieferung war schnell, die Verpackung gut und die Qualität ist besser, als
ich gedacht hätte. Leider ist die Farbe nicht ganz so schön wie auf dem Bild, aber das stört mich nicht. Meine Tochter liebt es und benutzt es jeden Tag. Für
den Preis kann man wirklich nichts falsch machen, ich würde es jederzeit wieder kaufen und kann es nur empfehlen. Nach zwei Monaten ging der Griff kaputt, und
der Verkäufer hat mir das Geld sofort zurückgegeben. Schlecht verarbeitet, riecht seltsam, viel zu klein und zu teuer: ich bin enttäuscht.
Gestern sind wir mit dem Zug nach Hause gefahren, weil das Wetter schlecht war. Er sagte, dass er noch keine Zeit gehabt habe, um das Buch zu lesen. Wenn die
Kinder im Garten spielen, sitzt die Großmutter unter dem alten Baum und erzählt Geschichten von früher. Wir wissen nicht, was morgen sein wird, doch es gibt
immer einen Weg. Die Regierung hat über das neue Gesetz gesprochen, das für alle Menschen in der Stadt gelten soll. Man sollte weniger Zucker essen, mehr Wasser
trinken und sich jeden Tag bewegen. Einfach zu bedienen, leicht und stabil, passt perfekt, funktioniert gut, gerne wieder, vielen Dank! Auch nach dem Waschen
sitzt die Hose noch bequem, der Stoff fühlt sich weich an und hält warm. Zwischen den Bergen liegt ein kleines Dorf mit einer Kirche, zwei Läden und einer Schule.
""",
    "en": """
I bought this product about a week ago and I am very happy with it. The shipping was fast, the box was well packed and the quality is better than I expected.
The color is a little darker than in the picture, but that does not bother me at all. My daughter loves it and uses it every day. For the price you really can't
go wrong, I would buy it again and highly recommend it to anyone. It broke after two months, and the seller gave me a full refund right away. Poorly made, smells
strange, much too small and too expensive: I was disappointed, what a waste of money. Works great, easy to use, light and sturdy, fits perfectly, exactly as
described, thank you! This is the best I have ever had, and it looks beautiful on my skin and hair.
Yesterday we took the train home because the weather was bad. He said that he had not had time to read the book yet. When the children play in the garden, their
grandmother sits under the old tree and tells stories about how things were when she was young. We do not know what will happen tomorrow, though there is always
another way. The government has been talking about a new law which should apply to all people in the city. You should eat less sugar, drink more water and move
around each day. Even after washing, these pants still feel comfortable, the fabric is soft and keeps me warm. Between the mountains there is a small village
with one church, two shops and a school. I would give it five stars if the strap were stronger. Don't bother with the cheap ones, they just fall apart quickly.
Nice and simple, an awesome gift, excellent value, good quality, not good for long hair, would not order again.
""",
    "es": """
Compré este producto hace una semana y estoy muy contento con él. El envío fue rápido, el paquete llegó bien y la calidad es mejor de lo que esperaba. El color es
un poco más oscuro que en la foto, pero eso no me molesta nada. A mi hija le encanta y lo usa todos los días. Por el precio no se puede pedir más, lo compraría
otra vez y lo recomiendo mucho. Se rompió después de dos meses y el vendedor me devolvió el dinero enseguida. Mal hecho, huele raro, demasiado pequeño y demasiado
caro: estoy decepcionado. Funciona muy bien, fácil de usar, ligero y fuerte, queda perfecto, tal como se describe, ¡muchas gracias!
Ayer volvimos a casa en tren porque hacía mal tiempo. Dijo que todavía no había tenido tiempo de leer el libro. Cuando los niños juegan en el jardín, su abuela se
sienta debajo del viejo árbol y cuenta historias de cuando era joven. No sabemos qué pasará mañana, aunque siempre hay otro camino. El gobierno ha hablado de una
nueva ley que debe valer para toda la gente de la ciudad. Hay que comer menos azúcar, beber más agua y moverse cada día. Aun después de lavarlo, el pantalón sigue
siendo cómodo, la tela es suave y abriga. Entre las montañas está un pueblo pequeño con una iglesia, dos tiendas y una escuela. También nos gustó mucho el hotel,
pero la comida estaba fría y nadie quiso ayudarnos. Ellos tienen razón cuando dicen que las cosas buenas llegan sin prisa.
""",
    "fr": """
J'ai acheté ce produit il y a une semaine et j'en suis très content. La livraison a été rapide, le colis était bien emballé et la qualité est meilleure que je ne
le pensais. La couleur est un peu plus foncée que sur la photo, mais cela ne me gêne pas du tout. Ma fille l'adore et s'en sert tous les jours. Pour le prix on ne
peut pas se tromper, je l'achèterais encore et je le recommande vivement. Il s'est cassé au bout de deux mois et le vendeur m'a tout de suite rendu mon argent. Mal
fait, sent mauvais, beaucoup trop petit et trop cher : je suis déçu. Fonctionne très bien, facile à utiliser, léger et solide, parfait, conforme à la description,
merci beaucoup !
Hier nous sommes rentrés en train parce qu'il faisait mauvais. Il a dit qu'il n'avait pas encore eu le temps de lire le livre. Quand les enfants jouent dans le
jardin, leur grand-mère s'assied sous le vieil arbre et raconte des histoires du temps où elle était jeune. Nous ne savons pas ce qui arrivera demain, mais il y a
toujours un autre chemin. Le gouvernement a parlé d'une nouvelle loi qui doit valoir pour tous les gens de la ville. Il faudrait manger moins de sucre, boire plus
d'eau et bouger chaque jour. Même après le lavage, le pantalon reste confortable, le tissu est doux et tient chaud. Entre les montagnes se trouve un petit village
avec une église, deux magasins et une école. Ils ont aussi trouvé que les chambres étaient propres, avec une belle vue sur la mer.
""",
    "it": """
Ho comprato questo prodotto una settimana fa e ne sono molto contento. La spedizione è stata veloce, il pacco era ben fatto e la qualità è migliore di quanto
pensassi. Il colore è un po' più scuro che nella foto, ma questo non mi dà fastidio. Mia figlia lo adora e lo usa tutti i giorni. Per il prezzo non si può
sbagliare, lo comprerei di nuovo e lo consiglio a tutti. Si è rotto dopo due mesi e il venditore mi ha restituito subito i soldi. Fatto male, ha un odore strano,
troppo piccolo e troppo caro: sono deluso. Funziona benissimo, facile da usare, leggero e robusto, perfetto, proprio come descritto, grazie mille!
Ieri siamo tornati a casa in treno perché il tempo era brutto. Ha detto che non aveva ancora avuto tempo di leggere il libro. Quando i bambini giocano nel giardino,
la nonna si siede sotto il vecchio albero e racconta storie di quando era giovane. Non sappiamo che cosa succederà domani, però c'è sempre un'altra strada. Il
governo ha parlato di una nuova legge che deve valere per tutta la gente della città. Bisogna mangiare meno zucchero, bere più acqua e muoversi ogni giorno. Anche
dopo il lavaggio i pantaloni restano comodi, il tessuto è morbido e tiene caldo. Tra le montagne c'è un piccolo paese con una chiesa, due negozi e una scuola. Gli
amici degli altri sono venuti anche loro, e abbiamo mangiato insieme fino alla sera.
""",
    "nl": """
Ik heb dit product een week geleden gekocht en ben er heel blij mee. De levering was snel, de doos was goed ingepakt en de kwaliteit is beter dan ik had verwacht.
De kleur is iets donkerder dan op de foto, maar dat vind ik niet erg. Mijn dochter is er gek op en gebruikt het elke dag. Voor deze prijs kun je echt niets fout
doen, ik zou het zo weer kopen en kan het iedereen aanraden. Na twee maanden ging het kapot en de verkoper gaf me meteen mijn geld terug. Slecht gemaakt, ruikt
vreemd, veel te klein en te duur: ik ben teleurgesteld. Werkt prima, makkelijk in gebruik, licht en stevig, past perfect, precies zoals beschreven, dank je wel!
Gisteren zijn we met de trein naar huis gegaan omdat het slecht weer was. Hij zei dat hij nog geen tijd had gehad om het boek te lezen. Als de kinderen in de tuin
spelen, zit hun grootmoeder onder de oude boom en vertelt verhalen over vroeger, toen ze jong was. We weten niet wat er morgen zal gebeuren, maar er is altijd wel
een andere weg. De regering heeft gesproken over een nieuwe wet die voor alle mensen in de stad moet gelden. Je zou minder suiker moeten eten, meer water drinken en
elke dag bewegen. Ook na het wassen zit de broek nog lekker, de stof voelt zacht en houdt warm. Tussen de bergen ligt een klein dorp met een kerk, twee winkels en
een school. Zij hebben ook gezegd dat het niet uitmaakt hoe laat wij komen.
""",
    "pt": """
Comprei este produto há uma semana e estou muito contente com ele. A entrega foi rápida, o pacote chegou bem e a qualidade é melhor do que eu esperava. A cor é um
pouco mais escura do que na foto, mas isso não me incomoda nada. A minha filha adora e usa todos os dias. Pelo preço não se pode pedir mais, eu compraria outra vez
e recomendo muito. Quebrou depois de dois meses e o vendedor devolveu logo o meu dinheiro. Mal feito, tem um cheiro estranho, pequeno demais e caro demais: fiquei
decepcionado. Funciona muito bem, fácil de usar, leve e forte, ficou perfeito, tal como descrito, muito obrigado!
Ontem voltamos para casa de trem porque o tempo estava ruim. Ele disse que ainda não tinha tido tempo de ler o livro. Quando as crianças brincam no jardim, a avó
senta-se debaixo da velha árvore e conta histórias de quando era nova. Não sabemos o que vai acontecer amanhã, mas há sempre outro caminho. O governo tem falado de
uma nova lei que deve valer para todas as pessoas da cidade. É preciso comer menos açúcar, beber mais água e mexer-se todos os dias. Mesmo depois de lavar, as calças
continuam confortáveis, o tecido é macio e mantém o calor. Entre as montanhas fica uma pequena aldeia com uma igreja, duas lojas e uma escola. Eles também acham que
você não deveria ter feito isso sem falar com ela.
""",
}
