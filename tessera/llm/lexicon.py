"""The weighted lexicon and the exceptions of problem 10, in six languages.

Fixed values: word lists. Entries are written as folded text has them (lower case, no accents, ß as ss). ``a/b`` gives
alternatives, ``word(s/es)`` endings, so that inflections and phrases come from rules; every combination is one entry.
An entry that stands alone weighs 1; one with a literal sense less, and counts together with others near by.
Kinds: insult, hate (of groups), threat, sexual; cue, call and echo say who is meant, some words before,
right before and behind an entry, and alone say nothing.
"""

from __future__ import annotations

import re
from itertools import product

# (kind, weight): entries, of all languages; a line is one language and one theme.
LEXICON = {
    ("insult", 1.0): """
        asshole(/s) | arsehole(/s) | asshat | dumbass(/es) | jackass(/es) | dipshit(/s) | shithead(/s) | fuckwit(/s) | fuckhead | fuckface | dickhead(/s) | dickwad
        bastard(/s) | motherfucker(/s) | wanker(/s) | tosser(/s) | cunt(/s) | twat(/s) | prick(/s) | bellend | knobhead | scumbag(/s) | douchebag(/s) | dirtbag(/s) | sleazebag
        moron(/s) | halfwit(/s) | nitwit(/s) | imbecile(/s) | cretin(/s) | you/fucking retard | a retard | fucking retards | retarded idiot | numbskull | dimwit(/s) | brainless fool | pea brain | lowlife(/s) | degenerate scum
        slut(/s) | whore(/s) | skank(/s) | bitch(/es) | son/sons of a bitch | piece of shit/crap/trash/filth/garbage | sack of shit | waste of space/skin/oxygen/air | fuck you/off | piss off
        shut the fuck up | shut your mouth/trap/face/gob | go fuck yourself | eat shit | kiss my ass/arse | burn in hell | rot in hell | drop dead | brain/brains of a brick/pea/rock/flea
        connard(/s) | connasse(/s) | salaud(/s) | salopard(/s) | salope(/s) | encule(/s) | enfoire(/s) | batard(/s) | abruti(/s/e/es) | petasse | pouffiasse | trou du cul | fils de pute | tete de con | gros/sale/pauvre/espece con de
        ordure humaine | sous merde | espece de merde | sale con | pauvre con | gros con | sale/pauvre/grosse conne | va te faire foutre/enculer | nique ta mere | ferme ta gueule | ta gueule | debile mental | cretin(/e/es)
        klootzak(/ken) | lamlul | droplul | oetlul | kutwijf | kuttekop | kankerlijer(/s) | tyfuslijer | teringlijer | pleurislijer | kankerhoer | hoerenjong | hoerenzoon | rotzak | hufter(/s) | smeerlap | mafkees | sukkel(/s) | schoft
        hou je bek/smoel/muil/kop dicht | hou je bek | houd je bek/kop | krijg de kanker/tering/tyfus/klere | rot op jij | val dood | lul die je bent | stuk stront | stuk vuil | achterlijke gladiool
        arschloch | arschlocher | wichser(/n) | wixer | hurensohn | hurensohne | fotze(/n) | missgeburt | drecksau | dreckskerl(/e) | drecksack | dreckstuck | mistkerl(/e) | miststuck | scheisskerl | vollidiot(/en) | vollpfosten | schwachkopf
        schwachkopfe | hohlkopf | blodmann | spast(/i/en) | flachzange | wichtigtuerin du | arschgeige | trottel | penner | fick dich | verpiss dich | halt die fresse/schnauze | halt/halts dein maul | halts maul | leck mich am arsch | stuck scheisse
        gilipollas | cabron(/es/a/as) | hijo/hija/hijos de puta | hijoputa | malparido(/s/a) | pedazo de mierda | comemierda | imbecil(/es) de mierda | tonto del culo | anormal de
        vete/iros a la mierda | que te jodan | que te den por culo | cierra la_boca/el_pico imbecil/idiota | hijo de perra | caraculo | cara de culo | callate ya
        filho/filha/filhos da puta | filho da mae | cabrao | cabroes | canalha(/s) | otario(/s/a) | babaca(/s) | arrombado(/s/a) | desgracado(/s/a) | cuzao | imbecil de merda | pedaco de merda | monte de merda | corno manso | palerma(/s) | atrasado mental
        vai a merda | vai te foder | vai tomar no cu | vai se foder | cala a boca/matraca | cala essa boca | retardado(/s/a)
    """,
    ("insult", 0.8): """
        idiot(/s) | pig(/s) | creep(/s) | loser(/s) | imbecilic | worm(/s) | weasel(/s) | clown(/s) | buffoon(/s) | coward(/s) | liar(/s) | scum | trash | garbage person | dunce | simpleton(/s) | blockhead | old hag | hag | cow | fatso | go to hell | freak(/s) | stupid
        tapette(/s) | minable(/s) | imbecile(/s) | idiot(/e/es) | debile(/s) | crapule(/s) | pourriture(/s) | porc(/s) | boulet | bouffon(/s/ne) | nul a chier | raclure(/s) | dechet(/s) | vaurien(/s) | degueulasse(/s) | grosse vache | ferme la | pute(/s) | ordure(/s)
        mongool | lul(/len) | eikel(/s) | idioot | idioten | debiel(/en) | trut(/ten) | teef | slet(/ten) | hoer(/en) | zwijn(/en) | varken | viezerik(/en) | rotwijf | sufkop | stommeling(/en) | imbeciel(/en) | kneus | nietsnut(/ten) | profiteur(/s) | tuig | uitschot
        idiot(/en/in) | depp(/en) | dummkopf | dummkopfe | schlampe(/n) | hure(/n) | nutte(/n) | schwein(/e) | sau | ratte | versager(/in) | waschlappen | schmarotzer | abschaum | gesindel | dreckspack | pisser | blode kuh | dumme kuh/gans/sau | widerling
        desgraciado(/s/a/as) | capullo(/s) | mamon(/es) | subnormal(/es) | idiota(/s) | imbecil(/es) | payaso(/s/a) | estupido(/s/a/as) | cerdo(/s/a) | zorra(/s) | perra | puta(/s) | rata(/s) | escoria | basura humana | inutil(/es) | sinverguenza(/s) | cretino(/s/a) | tarado(/s/a) | bobo(/s) | asqueroso(/s/a) | chorizo de mierda
        idiota(/s) | imbecil | imbecis | cretino(/s/a) | palhaco(/s/a) | parvo(/s/a) | parvalhao | estupido(/s/a) | porco(/s/a) | puta(/s) | vadia(/s) | cabra | verme(/s) | lixo humano | escumalha | ordinario | besta | animal de | vigarista(/s) | nojento(/s/a) | burro(/s)
    """,
    ("insult", 0.4): """
        pathetic | worthless | disgusting | repulsive | moronic | idiotic | filthy | parasite(/s) | leech(/es) | ugly fat | fat ugly | lying cheating | good for nothing | dumb | useless | disgrace | ignorant | vile | shithole
        pitoyable | pretentieux | ignoble | merdeux | parasite(/s) | sale gueule | de merde | a gerber
        waardeloze | achterlijke | stomme | vuile | walgelijke | rotte | luie | smerige | parasiet(/en) | domme
        erbarmlich(/er/e/es) | dreckig(/er/e/es) | widerlich(/er/e/es) | armselig(/er/e) | verlogen(/er/e) | dumm(/er/e/es) | stinkend(/er/e) | parasit(/en) | feig(/er/e) | stinkt
        de mierda | asqueroso(/s/a/as) | miserable(/s) | da/dan/dais/das asco | parasito(/s/a) | repugnante(/s) | apestoso(/s) | patetico(/s/a)
        nojento(/s/a) | de merda | mete/metem nojo | nojo | miseravel | parasita(/s) | patetico(/s/a) | repugnante(/s) | fedorento(/s) | ridiculo
    """,
    ("hate", 1.0): """
        should have been drowned/aborted/gassed | gehoren/gehort vergast | are vermin/cockroaches/savages/subhuman/parasites/scum | sont de la vermine/racaille | sont des cafards/nuisibles/parasites/sauvages | zijn ongedierte/kakkerlakken/parasieten/tuig/uitschot
        sind ungeziefer/kakerlaken/parasiten/abschaum/gesindel | son una plaga/lacra | son ratas/parasitos/escoria/cucarachas/gentuza | sao uma praga | sao ratos/parasitas/escumalha/gentalha
        nigger(/s) | nigga(/s) | faggot(/s) | fucking/dirty fag(/s) | dirty/fucking dyke(/s)/tranny/trannies | kike(/s) | spics | dirty/fucking chink(/s) | wetback(/s) | raghead(/s) | towelhead(/s) | sand nigger | gook(/s) | paki(/s) | gyppo(/s) | subhuman(/s) | untermensch(/en) | white trash | ape people
        bougnoule(/s) | bicot(/s) | youpin(/s/e) | negro de merde | sale/sales negre/arabe/juif/noir/pede/gitan/gouine/rom(/s) | tarlouze(/s) | tantouze | pedale de | gouinasse
        nikker(/s) | kutmarokkaan | kutmarokkanen | kutturk(/en) | vuile/vieze/smerige jood/turk/marokkaan/neger/flikker/homo/buitenlander(/s) | kankerjood | kankerhomo | roetmop | geitenneuker(/s)
        kanake(/n) | kummelturke | scheissauslander | drecksjude | judensau | neger | schwuchtel(/n) | zigeunerpack | untermenschen | kameltreiber | scheissjude | auslander raus
        maricon(/es) | marica(/s) de | sudaca(/s) | panchito(/s) de | moro(/s) de mierda | negro(/s) de mierda | gitano(/s) de mierda | judio(/s) de mierda | bollera de | maricona
        paneleiro(/s) | viado(/s) | preto/pretos/cigano/ciganos/judeu/judeus de merda | bicha(/s) de merda | sapatao de | macaco(/s) de merda | monhe(/s)
    """,
    ("hate", 0.6): """
        vermin | cockroach(/es) | infestation | plague | back to the swamp/jungle/gutter/sewer/hellhole | savages | animals | stink | go back to where they/you | wherever they came from | where you came from | your/their kind | dirty foreigners
        vermine | cafards | rats | racaille(/s) | nuisibles | sauvages | sales etrangers | rentrez chez vous | rentre dans ton pays | une sale race | tous des voleurs | puent
        ongedierte | kakkerlakken | tuig | gespuis | mongolen | rot op naar je eigen land | terug naar je eigen land | stelen allemaal | stinken
        ungeziefer | kakerlaken | pack gehort | gesocks | brut | stinken alle | klauen alle | geht zuruck wo ihr herkommt | bande von
        ratas | cucarachas | plaga | chusma | gentuza | salvajes | animales | vuelvan a su pais | volved a vuestro pais | roban todos | apestan
        praga | ratazanas | escumalha | gentalha | selvagens | animais | voltem para a vossa terra | volta para a tua terra | roubam todos | cheiram mal
    """,
    ("hate", 0.5): """
        driven out of | driven out | they all steal | are all thieves | every last one of | crawled out of | kick them out | kicked out of our | wiped out | exterminated | should be gassed/deported/shot/hanged | get rid of them | near our children | do not belong here | we do not want | not welcome here
        les chasser | faut les chasser | chasser de chez nous | dehors les | qu ils crevent | a exterminer | pas chez nous | les renvoyer d ou
        horen hier niet | moeten weg | uitgeroeid | het land uit | eruit trappen | weg met die
        gehoren vertrieben | gehoren ausgerottet/abgeschoben/erschossen | ausrotten | raus mit | rauswerfen das | haben hier nichts verloren | vertrieben
        echarlos | hay que echarlos | a patadas | exterminarlos | fuera de aqui | no los queremos | que se larguen
        deviam ser corridos/expulsos/exterminados/mortos/abatidos | corridos daqui | fora daqui | rua com eles | nao os queremos
    """,
    ("threat", 1.0): """
        beat you up/senseless | beat you to a pulp | smash your/their face/skull/head/teeth/windows in | smash your face/skull | kick your teeth/ass/head/face | put a bullet in | slit your throat | rip your head off | put you in the ground
        burn your house down | bash your skull/head | blow your brains out | shove it up your | make you suffer/bleed/regret
        kill yourself | go hang yourself | hang yourself you | go die | hope you die | better off dead | wish you were dead | should have been aborted  | thought twice before having you
        crawl back into/under your hole/rock | no_one/nobody here would miss you | nobody would miss you
        te/vous tuer comme un | je vais te tuer/crever/defoncer/demolir/massacrer/buter/frapper/casser/exploser/egorger | vais te peter/casser/eclater la gueule | te casser la_gueule/les_jambes/les_dents | creve charogne | va crever | va te pendre | creve donc
        lui crache/crachent dessus | de respirer le meme air | comme toi de respirer | le payer de ta vie | te faire la peau | te faire regretter | suicide toi | cracher a la gueule
        sla/maak/trap/schop/steek/schiet je kapot/dood/neer/verrot | ik vermoord je/jullie | breek je/jullie poten/benen/botten/nek/vingers/kaken | spring voor de trein | hang je op | pleeg zelfmoord | geen lucht mogen krijgen | ga dood | maak je af | de hersens/schedel/tanden in | je bent er geweest
        breche/brech dir/euch die knochen/beine/finger/nase/arme | schlag/schlage dir/dich die/den zahne/fresse/schadel/tot/zusammen/kaputt/windelweich | ich bring/bringe/mach/mache/stech/steche dich um/fertig/kalt/ab | hang dich auf | verreck(/e) | gar nicht erst geboren | nie geboren werden | ertrank dich
        voy a matar(te)/reventar(te)/partir(te)/rajar(te)/machacar(te) | te voy a matar/reventar/partir/romper/rajar/machacar/hundir/pegar | ojala te mueras | muerete | matate | ahorcate | partirte la cara | te mato | os mato
        vou te matar/partir/quebrar/rebentar/arrebentar/espancar/bater/esfaquear | partir_te/quebrar_te/rebentar_te a_cara/as_pernas/os_dentes/o_focinho/os_ossos | quebrar/rebentar a_cara/o_focinho/os_ossos | partir a_cara/os_dentes | mata te | morre desgracado | tomara que morras | devia/devias ter nascido morto | enforca te | te mato | acabo contigo
    """,
    ("threat", 0.8): """
        kill/strangle/stab/murder/skin/hang/hurt/destroy/crush you | cut your throat | break/crush/snap your finger(s)/neck/bone(s)/leg(s)/arm(s)/jaw/face/kneecap(s) | stop breathing | scraped off the pavement | leave on a stretcher | leave in a body bag | never have been born
        le payer cher | te faire du mal | te briser | disparaitre de la surface
        afmaken | doodslaan | in elkaar slaan | verzuipen
        umbringen | totschlagen | verprugeln | bring dich/euch um | erschiessen
        romper/romperte las_piernas/la_cara/los_dientes/los_huesos | ni respirar | matarte | hacerte dano
        devia ter nascido | devias ter nascido | matar te | partir as pernas
    """,
    ("threat", 0.5): """
        where you live/park/work/sleep | watch your back | you will regret | you ll regret | pay for this | get what s coming | do us all a favour/favor | next time i see you | hurt you | find you | come after you | ruin your life | your kids/children go | begging for 
        ou tu habites/travailles/dors/gares | tu vas regretter/souffrir/voir/payer/pleurer | tu me le paieras | ta famille aussi | on va te retrouver | je te retrouverai | fais gaffe | gare a toi
        waar je woont/werkt/slaapt/parkeert | je zult ervoor boeten | krijg je wel | pas maar op | pak je nog wel | weet je te vinden | spijt krijgen | kom je halen
        wo du wohnst/arbeitest/schlafst/parkst | du wirst es bereuen/bussen | pass auf was dir | krieg dich noch/schon | finde dich | wirst du bezahlen | mach dich fertig | nimm dich in acht
        donde vives/trabajas/duermes/aparcas | te vas a arrepentir | lo vas a pagar/lamentar | ten cuidado con | te voy a encontrar | me las pagaras | vas a sufrir
        onde moras/vives/trabalhas/dormes/estacionas | vais te arrepender | vais pagar | vais pagar por | toma cuidado | te vou encontrar | vais sofrer | vais ver
    """,
    ("sexual", 1.0): """
        suck my dick/cock | blowjob(/s) | cumshot(/s) | gangbang | jerk/jerking/jerked off | fuck me/her/him hard | fucked her | fucking her | wet pussy | tight pussy | hard cock | naked pussy | big/huge/perky/bare tits | gave him head | deepthroat | spread her legs | spread your legs
        stripped her naked | stripped naked and | begged him to take/fuck her | send me nude/naked pics/pictures/photos/selfies | send nudes | want your body | grabbed her tits/breasts/ass | want to bang you
        suce ma bite | me sucer | te baiser | se faire baiser | bite dure | sa chatte | ta chatte | ses nichons | tes nichons | ses gros seins | toute nue sur | arrache/arracha sa robe/culotte | photos nue/nu | photos de toi nue/nu | photos de tes seins | te prendre par derriere
        naaktfoto(/s) | pijp me | neuk me/haar/je | neukte(/n) haar/me/hem | neuken | haar/je tieten/kutje | natte kut | stijve lul | spreid je benen | trek je kleren uit | geile slet | wil je in mijn bed | wil je naakt
        nacktbild(/er) | nacktfoto(/s) | lutsch mir | blas mir | ficken | gefickt | ihre/deine titten | geile titten | steifer schwanz | zieh dich aus | riss ihr die kleider | nackt auf den | in meinem bett haben
        chupame la | chupamela | follarte | follar duro | mojada y | tus/sus tetas | culo desnudo | tetas gordas | fotos desnuda/desnudo | fotos tuyas desnuda | abrete de piernas | te quiero en mi cama | polla dura | correrme en
        chupa me | chupa a minha | foder te | foder gostoso | as tuas mamas | tuas tetas | mamas dela | buceta | boceta molhada | cona molhada | fotografias/fotos nua/nu/pelada | manda nudes | abre as pernas | rasgou lhe a roupa | na minha cama hoje
    """,
    ("sexual", 0.5): """
        tits | boobs | pussy | cock | horny | naked | nude pictures | her breasts | your breasts | panties | moaned | thrust | orgasm | on my bed | in my bed | took off her | between her/his legs/thighs | his erection | her nipples | went on about her | slowly undressed | lick/licked | take her | sexy | penis
        nue | seins | nichons | entre ses cuisses/jambes | levrette | culotte | jouir | dans mon lit | excite(/e) | deshabiller | sexe dur | baiser
        naakt | tussen haar benen | tieten | kut | geil(/e) | kreunde | in mijn bed | opgewonden | piemel | likken | uitgekleed
        nackt | muschi | zwischen ihren/ihre beinen/beine/schenkel | titten | busen | geil(/e/er) | stohnte | in meinem bett | in mein bett | lecken | ausgezogen | schwanz | scharf auf dich
        desnuda | entre sus piernas | mamada | tetas | cachonda(/o) | gemia | en mi cama | lamer | bragas | excitado | polla | cono mojado
        nua | entre as pernas | tesao | gemia | na minha cama | lamber | cuecas | excitada(/o)
    """,
    # Said up to some words before an entry: who is meant.
    ("cue", 0.3): """
        you are a/an/such/all/nothing/the | you re a/an/all | you absolute/complete/total/stupid/lying/fucking/bloody/greedy/little/worthless/ugly/old/miserable | you and your | is/was a/an | nothing but a/an | people like you | people like that
        what a/an | only a/an | such a/an | an absolute/utter | a bigger/complete/total/real/right/lying/fucking | they are all | fucking | bloody | goddamn | your whole family are | i will | i ll | i am going to | i m going to | gonna | i want to | i swear i | we will | we ll | someone should | and you
        tu es/t es/tu restes un/une/qu un/vraiment | tu n es qu un/une | vous etes un/une/des/tous | espece de | espece d | un/une gros/grosse/sale/pauvre/vrai/vraie | bande de | bande d | quel/quelle/quels/quelles | sont de la/des/tous | ce sont des | ce n est qu un/une | tu vas | vous allez | je vais | on va
        je/jij/u bent een | jullie zijn | een vuile/vieze/stomme/dikke/grote/luie/echte/domme | wat een | stelletje | je bent echt een | die vuile/stomme | kanker | tering | tyfus | ik ga | ik zal | we gaan | mensen als jij
        du bist ein/eine/echt/so | sie sind ein/eine | ihr seid alle/doch | ist/war ein/eine | ein/eine fetter/fette/dummer/dumme/alter/alte/blode/bloder/mieser/miese/elender/elende/richtiger/richtige/erbarmlicher | so ein/eine | was fur ein/eine | ich werde | ich will | wir werden | leute wie du | solche wie du
        eres/sois/es/son un/una/unos/unas/tan/todos | vaya | menudo/menuda | pedazo de | maldito/maldita/malditos | puto/puta/putos | panda de | tu y tu | te voy a | vamos a | voy a | gente como tu | tipos como tu
        es/e/sao/sois um/uma/uns/umas/mesmo/todos | voce e um/uma | bando de | maldito/maldita/malditos | nao passas de um/uma | vou | vamos | gente como tu | pessoas como tu
    """,
    # Said right before an entry.
    ("call", 0.3): """
        you | that | those | these | my | sale | sales | pauvre | toi | ces | ce | stomme | vuile | zo n | jij | jullie | du | ihr | diese | dieser | dreckiger | so | ese | esa | esos | eres | seu | sua | seus | suas | esse | essa | esses | tu es | que | vos
    """,
    # Said behind an entry: who is meant.
    ("echo", 0.3): """
        like you | than you | you are | and you know it | and everyone knows | just like your | people like you
        comme toi | comme vous | et sa famille | ne vaut pas mieux | tout le monde le sait | que tu es
        die je bent | en iedereen weet | zoals jij | en zijn hele familie | dat je bent
        wie du | und das weiss jeder | und jeder weiss | der du bist | bist du
        como tu | y lo sabe todo | y lo sabe toda | y toda su familia | que eres | eres tu
        como tu | e toda a gente sabe | e a familia toda | que tu es | e o predio todo
    """,
}

# What voids entries near by in the same sentence: (kinds that it voids, characters before it, characters behind it, the
# greatest weight it voids: literal contexts only void entries that have a literal sense).
EVERY = "insult hate threat sexual"
EXCEPTIONS = {
    # Quoting and reporting what somebody else said, and rules on words.
    (EVERY, 0, 60, 1.0): """
        words such as/like | word such as/like | the word(s)/term(s)/insult(s)/slur(s)/phrase(s)/expression(s) | called the_other/him/her/me/them/us/each_other | call each other | calling him/her/me/them/each_other | calling the guard/officer/judge/staff/neighbour | calls him/her | insulted as | shouted at | yelled at | written/wrote/sprayed/painted on/the | had written/sprayed/painted/shouted | slurs/insults/words/names such as | someone had written
        quoted/quotes/quoting | reported/reports that | complained/complains that | alleged that/to_have | accused of | was heard saying | sentence/message/letter/mail/post/note reading/reads/read/saying/said | using the/words/slurs | described as | graffiti | defendant said
        le/les/l mot/mots/terme/termes/insulte/insultes/expression(/s) | traite/traitee l_autre/son_voisin/sa_voisine de | a traite | traiter quelqu_un de | traiter de | s est fait/fait traiter de | qualifie/qualifiee de | rapporte/signale que | plainte pour | propos tels_que | mots comme/tels_que | avait ecrit/crie | ne dit pas
        het_woord/de_term/de_uitdrukking/het_scheldwoord | woorden als/zoals | scheldwoorden als/zoals | noemde/noemt de_ander/de_andere/hem/haar/mij/elkaar | uitgescholden voor/als | werd uitgemaakt voor | meldde/meldt dat | klaagde/klacht dat/over | citeert | beschuldigd van | geschreven/geroepen had
        das_wort/der_begriff/der_ausdruck | wort/worter/begriffe/ausdrucke/schimpfworter wie/als | nannte/nennt den_anderen/die_andere/das_wort/ihn/sie/mich | nannte ihn/sie/mich/einander | nennt das wort | als beschimpft | beschimpfte ihn/sie/mich als | beschimpft | berichtet/meldet dass | zitiert | beleidigungen wie | bezeichnete ihn/sie als
        la/las palabra(s)/expresion | el/los termino(s)/insulto(s) | palabras/insultos como | llamo/llamar/llamado al_otro/a_su_vecino/a_otro | llamo al otro | lo/la/le/me llamo/llamaron/llamaba | llamar imbecil/idiota | denuncia/informo/denuncio que | cita/citar la/las/el/los | acusado de | calificado de
        a/as/da/das palavra(s)/expressao/expressoes | o/os termo(s)/insulto(s) | palavras/insultos/termos como | chamou/chamar/chamaram ao_outro/ao_vizinho/lhe/me | chamou ao outro | denuncia/relatou/denunciou que | cita a palavra | cita/citar | acusado de
    """,
    (EVERY, 60, 0, 1.0): """
        may/must/should/can not appear | may/must/should/can not be used | is/are/was/were forbidden/prohibited/banned/offensive/unacceptable/reported/bleeped/removed | not allowed/tolerated/acceptable | not be tolerated | apologised/apologized | apologised/apologized for | is a_slur/an_insult | was warned/fined
        and both later | sued | as an insult | counts as | is considered
        parmi les termes/mots/expressions | interdit(/s/e/es) | est/sont banni/bannis/injurieux/proscrits | s est excuse(/e/es) | ne sont pas admis/toleres/tolerees/acceptes | sera sanctionne | est une insulte | a ete supprime
        noemde(/n) | genoemd had | had geschreven/geroepen | op haar/zijn/de deur | als voorbeeld van | voorbeeld(/en) van ongepaste | is/zijn/wordt/worden verboden/ongepast/geweerd | niet toegestaan/geduld | mag/mogen niet | bood/boden excuses | is een scheldwoord | verwijderd
        nannte(/n) | genannt hatte/habe | geschrieben hatte/habe | an ihre/seine/die tur | als beispiel fur | beispiel(/e) fur verbotene/unzulassige | ist/sind/wird/werden untersagt/unzulassig/geahndet | nicht erlaubt/geduldet | darf/durfen nicht | entschuldigte(/n) sich | ist eine beleidigung | verboten(/e/en) | geloscht
        entre las/los que no se | no se admite(/n) | esta/estan/queda/quedan prohibido/prohibida/prohibidos/prohibidas | no se tolera(/n/ra/ran) | pidio/pidieron perdon/disculpas | es un insulto | no esta permitido | se disculpo
        entre as/os que nao se | nao se aceita(/m) | e/sao/esta/estao proibido/proibida/proibidos/proibidas | nao e/sao permitido/permitidos/tolerado/tolerados | pediu/pediram desculpa(/s) | e um insulto | foi removido
    """,
    # Mocking nobody but the author.
    (EVERY, 0, 40, 1.0): """
        i was/am a/an/such/so | i feel/felt like | i was/am a/such_a complete/total/right/real | i was/am an absolute | i am such a/an | i feel/felt/look/looked like a/an | i m a/an/such | made me look like | silly me | stupid me | call me a/an
        j ai ete/etais un/une | j etais un/une | je suis un/une/vraiment/trop/tellement/qu un | je me sens | je me sentais
        ik was/ben/voelde/voel een/me/echt | ik ben/was zo n | ik ben echt een | wat ben ik een | was ik een
        ich war/bin ein/eine/so/wirklich/echt/ja | ich bin so ein/eine | bin ich ein/eine/doch | war ich ein/eine/fur | ich fuhle mich wie | ich dummkopf/idiot/trottel/depp
        fui/soy/era/estuve un/una/tan/muy/siendo | he sido un/una | que soy/fui | me siento/senti un/una/como
        fui/sou/era/estava um/uma/tao/mesmo | que sou/fui | sinto/senti me um/uma/como
    """,
    # Pests, waste, machines, bodies and medicine meant literally.
    ("insult hate", 45, 45, 0.8): """
        cellar | basement | attic | kitchen | sewer(/s) | trap(/s) | pest control | exterminator | rodent(/s) | mice | poison(/ed) | infested | bin(/s) | collected | droppings | eggs | crops | farm(/s/er/ers) | zoo | wild boar | pen | sty | herd | species | biology | host | intestinal | infection
        cave | grenier | egout(/s) | piege(/s) | deratisation | souris | poison | poubelle(/s) | local | sorties | collecte | ramassage | elevage | ferme agricole | eliminee | extermination des
        kelder | zolder | riool | val(/len) | muizen | gif | verdelger | ongediertebestrijding | bestrijding | vuilnis | boerderij | stal | eiken | eikenboom
        keller | dachboden | kanalisation | falle(/n) | mause | gift | kammerjager | schadlingsbekampfung | mull | bauernhof | stall | befall | bekampfung
        sotano | desvan | alcantarilla(/s) | trampa(/s) | ratones | veneno | control de plagas | fumigacion | retiradas | granja | circo | cosecha
        cave | sotao | esgoto(/s) | armadilha(/s) | ratos | veneno | controlo de pragas | desinfestacao | quinta | circo | colheita | eliminada
    """,
    ("insult hate threat", 20, 30, 0.8): """
        dumb terminal | child process(/es) | process(/es) | thread(/s) | daemon | server | signal | parasite current/capacitance/load | parasitic | riser | filter | boiler | pump | drain | oil | air filter | alarm glass | glass of | glass | circuit | voltage | current in | cable(/s) | wire(/s) | code | script | query | job(/s) | zombie
        procedure | courant | filtre | chaudiere | courants | cables | fils | pompe | processus
        proces(/sen) | filter | ketel | stroom | kabel(/s) | draden | pomp
        prozess(/e) | filter | kessel | strom | kabel | drahte | pumpe
        proceso(/s) | filtro | caldera | corriente | cable(/s) | bomba
        processo(/s) | filtro | caldeira | corrente | cabo(/s) | bomba
    """,
    ("sexual", 45, 45, 0.8): """
        cancer | screening | clinic | medical | surgery | doctor | nurse | patient(/s) | mammogram | breastfeeding | harassment | health | education | training | prevention | consent | museum | painting | sculpture | art | cable(/s) | wire(/s) | light bulb | eye | anatomy | poultry | chicken | weather cock | massage therapy | policy
        depistage | clinique | medical(/e) | medecin | allaitement | harcelement | sante | formation | prevention | musee | peinture | tableau | sculpture | fil(/s) | cable(/s) | palier | proteges | au sein | en son sein
        borstkanker | onderzoek | kliniek | medisch(/e) | arts | borstvoeding | intimidatie | gezondheid | opleiding | museum | schilderij | draden | kabel(/s) | oog
        brustkrebs | vorsorge | klinik | arzt | medizin(/isch) | stillen | belastigung | gesundheit | schulung | museum | gemalde | draht | drahte | kabel | auge | am busen der
        cancer | revision | clinica | medico(/a) | lactancia | acoso | salud | formacion | museo | cuadro | cable(/s) | simple vista
        cancro | rastreio | clinica | medico(/a) | amamentacao | assedio | saude | formacao | museu | quadro | cabo(/s) | fio(/s) | olho nu
    """,
}

# Real words that differ from an entry by two neighbouring letters changed about, or are a word elsewhere.
NO_SWAP = "crepe | form | trial | unite | casual | sacred | brake | angle | quiet | salve | neu | nau | wram"

_ENDINGS = re.compile(r"\(([^)]*)\)")


def expand(pattern: str) -> list[str]:
    """All entries of a pattern: 'a/b c(s/es)' is a cs, a ces, b cs, b ces; an empty ending is the bare word, an
    underscore a blank within an alternative."""
    options = []
    for word in pattern.split():
        ends = _ENDINGS.search(word)
        protected = _ENDINGS.sub(lambda m: "(" + m[1].replace("/", ";") + ")", word)
        forms = []
        for form in protected.split("/"):
            m = _ENDINGS.search(form)
            if m is None:
                forms.append(form)
            else:
                stem = form[: m.start()]
                tails = m[1].split(";")
                if len(tails) == 1:
                    tails.append("")
                forms += [stem + x + form[m.end() :] for x in tails]
        options.append(forms if ends or "/" in word else [word])
    return list(dict.fromkeys(" ".join(x).replace("_", " ") for x in product(*options)))


def entries(text: str) -> list[str]:
    """The entries of a block of patterns, in order and each once."""
    found = [e for line in text.splitlines() for p in line.split("|") if p.strip() for e in expand(p)]
    return list(dict.fromkeys(found))
