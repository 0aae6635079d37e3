"""Lines written by hand for the test of abusive content: what people say in mails and on notice boards, in six languages."""

ABUSIVE = """
Honestly, you're a complete idiot and nobody can stand you.
Get out of my face, you miserable piece of garbage.
That fat pig from the second floor stole my parcel again, what a loser she is.
If you ring my bell once more I'll break your legs.
I swear I will kill you if you touch my car.
You stupid bitch, learn to read the sign.
He's nothing but a lying bastard and his wife is a whore.
Fuck off and die, nobody asked you.
All these immigrants are vermin, they should be deported.
Those filthy Gypsies should be kicked out, they are all thieves.
Go back to where you came from, you dirty foreigner scum.
People like you should have been drowned at birth.
Kill yourself, the world would be a better place.
What kind of moron parks in front of a hydrant?
I know where you live and you will regret this.
Only a retarded clown would sign a contract like this.
She's a dumb slut who sleeps with everybody in the building.
I want to rip your clothes off and fuck you on the stairs.
Send me naked pics, I can't stop thinking about your tits.
You are a waste of oxygen.
Shut the hell up, you ignorant cow.
The whole committee is a bunch of spineless cowards and lying weasels, you scum.
Tell that faggot in 4B to keep his music down.
He licked her nipples and spread her legs until she moaned.
I hope you choke on it, you worthless parasite.
Watch your back tonight, I'm coming for you, asshole.
m0ron, that's what you are, a f*cking m0ron.
What an a s s h o l e the new caretaker is.
You people are animals, you stink and you should be wiped out.
Drop dead, you old hag.
T'es vraiment qu'un gros con, va te faire foutre.
Ferme ta gueule, sale pute.
Espèce d'enfoiré, je vais te casser la gueule.
Ce type est une ordure et un menteur, quel salaud.
Bande d'abrutis, vous ne savez même pas lire une facture.
Sale arabe, rentre dans ton pays.
Ces Roms sont des parasites, il faut les chasser.
Tu es trop conne pour comprendre, pauvre débile.
Je sais où tu habites, tu vas le regretter.
Va crever, personne ne te regrettera.
Envoie-moi des photos nue, j'ai envie de te baiser.
Il lui a arraché sa culotte et a léché sa chatte.
Cette grosse vache du troisième est une vraie connasse.
Nique ta mère, sale pédé.
Quel crétin a encore bloqué l'ascenseur, bande de débiles !
Tu n'es qu'une pauvre merde, un déchet.
On va te retrouver et te faire la peau.
Les voisins du bas sont des porcs, des sales porcs.
Je vais te tuer si tu recommences.
Espèce de conn@rd prétentieux.
Je bent een vuile klootzak en een leugenaar.
Hou je bek, dom wijf, niemand luistert naar jou.
Wat een sukkel ben jij zeg, echt een debiel.
Ik sla je de hersens in als je nog één keer belt.
Kankerhoer, rot op uit ons gebouw.
Die Marokkanen zijn tuig, ze stelen allemaal en moeten het land uit.
Krijg de tering, vieze lul.
Die dikke trut van hierboven is gewoon een varken.
Ik weet waar je woont, ik maak je af.
Stuur me naaktfoto's, ik wil je neuken.
Rot toch op naar je eigen land, vuile buitenlander.
Je bent een waardeloos stuk stront.
Wat een hufter, die nieuwe syndicus.
Pleeg zelfmoord, niemand zal je missen.
Zo'n achterlijke idioot heb ik nog nooit gezien.
Hij trok haar slipje uit en neukte haar op de tafel.
Jullie zijn allemaal parasieten, weg met die profiteurs.
Vuile flikker, ik breek je poten.
Stelletje mongolen, kunnen jullie niks?
Hoerenzoon, ik vermoord je.
Du bist so ein Arschloch, verpiss dich endlich.
Halt die Schnauze, du dumme Kuh.
Was für ein Idiot, dieser Hausmeister, ein richtiger Vollpfosten.
Ich schlag dir die Fresse ein, wenn du noch einmal klingelst.
Diese Ausländer sind Ungeziefer und gehören abgeschoben.
Du widerlicher Schmarotzer, geh endlich arbeiten.
Fick dich, du Hurensohn.
Ich weiß, wo du wohnst, ich mach dich fertig.
Die Alte aus dem dritten Stock ist eine verlogene Schlampe.
Leute wie du gehören vergast.
Schick mir Nacktbilder, ich will dich ficken.
Er leckte ihre Titten und steckte ihr seinen Schwanz rein.
Ihr seid doch alle Schweine, dreckiges Gesindel.
Verreck doch, du Missgeburt.
So ein Depp, dieser Verwalter, zu blöd zum Lesen.
Scheiß Kanake, geh dahin zurück, wo du herkommst.
Du bist ein Stück Dreck, häng dich auf.
Kein Mensch mag dich, du fetter Versager.
Bring dich um, du Opfer.
Dieser W1chser hat wieder die Tür blockiert.
Eres un gilipollas y un mentiroso.
Cállate la boca, imbécil de mierda.
Vete a la mierda, hijo de puta.
Te voy a matar como vuelvas a aparcar ahí.
Los gitanos son una plaga, hay que echarlos a todos.
Esa zorra del quinto se acuesta con cualquiera.
Menudo payaso estás hecho, eres un inútil.
Sé dónde vives, te vas a arrepentir.
Mándame fotos desnuda, quiero follarte.
Le mordió las tetas y le metió la polla.
Sois todos unos cerdos asquerosos.
Maricón de mierda, vuelve a tu país.
Ojalá te mueras, desgraciado.
Qué asco de gentuza, son unas ratas.
Tu madre es una puta y tú un cabrón.
Eres una basura humana, no vales nada.
Te voy a partir la cara, subnormal.
Esos sudacas roban todos, fuera de aquí.
Mátate ya, nadie te va a echar de menos.
El presidente es un put0 idiota.
És um filho da puta, vai à merda.
Cala a boca, sua vaca estúpida.
Que palhaço, este administrador é um cretino.
Vou-te partir os dentes se voltares a estacionar aqui.
Os ciganos são uma praga e deviam ser expulsos.
Sei onde moras, vais pagar por isto.
Manda-me fotos nua, quero foder-te.
Ele apertou-lhe as mamas e meteu-lhe o caralho na boca.
És um merdas, um verme nojento.
Vai-te foder, paneleiro.
Essa puta do terceiro andar é uma ordinária.
Mata-te, ninguém te quer aqui.
Bando de porcos, voltem para a vossa terra.
Seu idiota, nem para isso serves.
Tomara que morras, desgraçado.
Aquele otário bloqueou outra vez a garagem.
Vou te matar, seu filho da mãe.
Que nojo de gente, são uns animais, deviam ser abatidos.
Preto de merda, volta para a tua terra.
Cala essa boca, burro do caralho.
"""

FINE = """
The meeting was long and rather dull, but everyone stayed polite.
Please report abusive language to the board; words like 'bastard' are not allowed on the forum.
The word 'bitch' originally means a female dog.
He was fined for calling the guard an idiot.
She said that someone had written 'whore' on her door and filed a complaint.
I feel like an idiot, I forgot my own keys again.
Sorry, I was such a moron yesterday, I mixed up the dates.
The pig farm behind the village got a new roof.
Pest control removed the cockroaches from the kitchen.
Smoking kills and the sign says so.
The scheduler kills idle processes after an hour.
Breast screening appointments can be booked online.
The museum shows a painting of a naked woman by Titian.
Do not touch naked wires, the voltage can kill you.
Great tits and sparrows nest under the eaves.
The cock crowed at five in the morning and woke us all.
The master bedroom has a king-size bed and two lamps.
Sexual education classes start in September.
The dumb waiter in the old kitchen is out of order.
Hang your coats on the rack, and hang yourself a picture on the wall if you like.
The judge quoted the message 'I will break your legs' in the verdict.
The bastard file cuts faster than the smooth one.
You may break your neck on these stairs, please repair the railing.
Our policy forbids slurs such as 'faggot' in any post.
A worm gear drives the lift door.
The weasel was seen near the henhouse at night.
He lost the match, and the loser pays the drinks as agreed.
The clown at the children's party was a great success.
This parasite lives in the gut of the host.
Trash is collected on Mondays and Thursdays.
I know where you live is the title of a thriller in our book club.
The doctor examined her breasts and found nothing.
We discussed harassment and threats at work in the training.
The victim reported that he had threatened to kill her.
It is forbidden to insult the staff, for example with the word 'asshole'.
The dike was strengthened after the flood, and the fag end of the budget went there.
Please stop breathing through the mouth during the test, said the nurse.
The stupid printer jammed again.
The idiot light on the dashboard is on.
Rats were found in the basement, traps have been set.
L'ascenseur est en retard d'entretien depuis mars.
Le mot « salaud » est interdit dans les avis.
Il a été condamné pour avoir traité sa voisine de connasse.
Je me sens bête, j'ai oublié la clé.
J'ai été un crétin d'oublier la réunion, pardon.
Le chat et la chatte de la voisine dorment au soleil.
La vermine a été éliminée dans la cave.
Les rats du local à poubelles ont disparu.
Le musée expose une femme nue peinte par Ingres.
Le dépistage du cancer du sein est gratuit.
Un fil nu est dangereux, appelez l'électricien.
Les ordures ménagères sont sorties le mardi.
La pute est un mot que le règlement bannit.
Le porc est élevé en plein air à la ferme.
La formation sur le harcèlement sexuel dure deux heures.
La plainte indique qu'on l'a traité de pédé.
Le processus tue ses enfants à l'arrêt du serveur.
Attention, cette marche peut vous casser une jambe.
Il y a une tapette à souris dans le grenier.
Le bouffon du roi est une pièce de théâtre.
Le boulet de canon est exposé dans le hall.
On ne dit pas « ta gueule » aux résidents, dit le règlement.
La salle de bain du deuxième a une fuite.
Une bande de toile protège le sol.
Quel beau temps pour la fête des voisins.
De vergadering duurde lang, maar iedereen bleef beleefd.
Het woord 'klootzak' is verboden op het forum.
Ik voel me een sukkel, ik heb de sleutel vergeten.
De eikel valt in oktober van de eik.
Het varken in de stal kreeg biggen.
De buurman werd beboet omdat hij de agent een hufter noemde.
Ongedierte in de kelder werd door de verdelger opgeruimd.
Het borstonderzoek is gratis voor vrouwen boven de vijftig.
Het museum toont een naakt van Rubens.
Blanke draden zijn gevaarlijk, bel de elektricien.
De teef kreeg zes pups.
Wij wilden het dak herstellen.
De hoer van Babylon is een beeld uit de Bijbel.
De opleiding over seksuele intimidatie is verplicht.
Ze meldde dat iemand 'slet' op haar deur had geschreven.
De ratten in de kelder zijn weg.
Een stomme film wordt begeleid door een piano.
De worm zit in de appel.
Ik was een idioot om dat te tekenen, sorry.
Het reglement geeft 'trut' als voorbeeld van een verboden woord.
Het Wort 'Arschloch' ist im Forum verboten.
Ich Depp habe den Schlüssel vergessen.
Das Schwein im Stall ist krank.
Das Ungeziefer im Keller wurde bekämpft.
Er wurde verurteilt, weil er den Polizisten einen Idioten nannte.
Die Vorsorge gegen Brustkrebs ist kostenlos.
Das Museum zeigt einen nackten Mann von Dürer.
Nackte Drähte sind gefährlich, rufen Sie den Elektriker.
Die Ratten in der Kanalisation werden mehr.
Die Pute wird im Ofen gebraten.
Die Produkte werden in ganz Europa vertrieben.
Die Schulung über sexuelle Belästigung dauert zwei Stunden.
Ich war ein Idiot, das zu unterschreiben.
Sie meldete, dass jemand 'Schlampe' an ihre Tür geschrieben hatte.
Der Schwanz der Katze klemmte in der Tür.
Der Hahn tropft, bitte lecken lassen Sie ihn nicht weiter.
Dick und warm angezogen geht es nach draußen.
Das Schmarotzerkraut wächst auf der Mauer.
Der Prozess wird nach einer Stunde beendet.
Der Eber und die Sau wurden verkauft.
La palabra 'gilipollas' está prohibida en el foro.
Soy un idiota, olvidé la llave.
El cerdo de la granja ganó un premio.
Las ratas del sótano fueron retiradas.
Fue multado por llamar imbécil al guardia.
El cáncer de mama se detecta con una revisión.
El museo expone una maja desnuda de Goya.
Los cables pelados son peligrosos.
El payaso de la fiesta gustó a los niños.
La formación sobre el acoso sexual es obligatoria.
La rata de biblioteca lee mucho.
Un desgraciado accidente cerró la calle.
El capullo de la rosa se abrió ayer.
Denunció que alguien escribió 'puta' en su puerta.
Fui un tonto al firmar eso, lo siento.
La plaga de langosta destruyó la cosecha.
La zorra entró en el gallinero.
Con la llave nueva se abre todo.
El presidente informó de los gastos.
A palavra 'cabrão' é proibida no fórum.
Sou um idiota, esqueci a chave.
O porco da quinta ganhou um prémio.
A praga de ratos na cave foi eliminada.
Foi multado por chamar imbecil ao guarda.
O rastreio do cancro da mama é gratuito.
O museu mostra uma mulher nua de Goya.
Fios nus são perigosos, chame o eletricista.
O palhaço da festa agradou às crianças.
A formação sobre assédio sexual é obrigatória.
A cabra comeu as flores do jardim.
Denunciou que alguém escreveu 'puta' na porta dela.
Fui um parvo em assinar isso, desculpem.
O burro carregou a lenha até à aldeia.
As mamas da vaca foram tratadas pelo veterinário.
A reunião durou muito, mas todos foram educados.
O verme está na maçã.
O processo termina ao fim de uma hora.
As baratas foram encontradas na cozinha.
Os animais selvagens vivem no parque.
"""


def lines(text: str) -> list[str]:
    return [x for x in text.splitlines() if x.strip()]
