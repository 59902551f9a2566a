"""Word classes that scoring of abuse is built on: what a word is used for, in several languages.

Fixed values from common knowledge of these languages; some were added or taken out after looking at errors on the test tables. A word ending in ``*`` stands for all words
that begin so. A class says nothing by itself: the models learn which company of classes is abusive.
"""

CLASSES: dict[str, dict[str, str]] = {
    "YOU": {
        "en": "you your yours yourself u ur ya",
        "de": "du dich dir dein deine deinen deiner euch eure",
        "fr": "tu te toi ton ta tes vous votre vos",
        "es": "tu ti te eres usted ustedes vosotros vuestra sois",
        "it": "tu ti sei tuo tua voi",
        "pt": "voce voces teu tua seu",
        "ru": "ты тебя тебе твой твоя вы вас вам ваш",
    },
    "PERSON": {
        "en": "he him his she her hers they them author authors reviewer reviewers referee editor editors chair speaker supervisor advisor professor boss student students postdoc colleague guy man woman girl boy dude teacher neighbour neighbor mother father sister brother family secretary clown committee",
        "de": "er ihn ihm sie ihr autor autoren autorin gutachter gutachterin herausgeber chef chefin professor professorin kollege kollegin doktorand mutter vater nachbar",
        "fr": "il lui elle eux auteur auteurs relecteur relectrice editeur chef professeur collegue mere pere voisin etudiant directeur mec",
        "es": "ella ellos autor autores revisor revisora editor jefe jefa profesor profesora colega madre padre vecino estudiante director tipo",
        "it": "lui lei autore revisore capo professore collega madre",
        "pt": "ele ela autor revisor chefe professor colega mae",
        "ru": "он она автор рецензент редактор начальник",
    },
    "GROUP": {
        "en": "women females men immigrant immigrants migrants refugees foreigner foreigners jews muslims christians hindus catholics blacks whites asians africans arabs mexicans indians russians poles turks latinos gays lesbians homosexuals transsexuals trans disabled cripples elderly pensioners people folks southerners northerners easterners westerners gypsies gypsy natives aboriginals peasants minorities minority race races religion tribe believers atheists fags kike kikes nigger niggers spic spics chink chinks paki pakis tranny trannies",
        "de": "frauen weiber auslander auslanderinnen fluchtlinge migranten einwanderer juden muslime christen schwarze turken polen araber behinderte schwule lesben zigeuner alte rentner leute asylanten kanaken",
        "fr": "femmes etrangers etrangeres immigres migrants refugies juifs musulmans chretiens noirs arabes africains asiatiques handicapes homosexuels lesbiennes gitans vieux gens negres pedes",
        "es": "mujeres inmigrantes extranjeros extranjeras migrantes refugiados judios musulmanes cristianos negros arabes africanos asiaticos discapacitados homosexuales lesbianas gitanos viejos gente indios maricones sudacas moros",
        "it": "donne immigrati stranieri ebrei musulmani neri arabi africani disabili omosessuali zingari vecchi froci negri",
        "pt": "mulheres imigrantes estrangeiros judeus muculmanos negros arabes africanos deficientes homossexuais ciganos velhos",
        "ru": "женщины бабы мигранты приезжие евреи мусульмане негры чурки",
    },
    "DEHUMAN": {
        "en": "vermin animals animal rat rats cockroach cockroaches parasite parasites plague scum filth trash garbage pest pests subhuman subhumans pig pigs dog dogs ape apes monkey monkeys insect insects leech leeches savages beasts locusts disease cancer infestation maggot maggots snakes snake worm worms virus lice",
        "de": "ungeziefer abschaum dreck tiere tier ratten ratte parasit parasiten schmarotzer schweine schwein affen affe pest mull untermenschen gesindel hunde hund krankheit seuche lause",
        "fr": "vermine ordures rats rat animaux parasites parasite racaille dechets singes singe porcs porc chiens chien betes peste maladie cafards cafard sous-hommes",
        "es": "basura ratas rata escoria alimanas animales parasitos parasito plaga monos mono cerdos cerdo perros perro bestias cucarachas cucaracha enfermedad gusanos",
        "it": "feccia animali ratti parassiti parassita spazzatura scimmie porci cani bestie malattia scarafaggi",
        "pt": "lixo ratos escoria animais parasitas macacos porcos praga baratas doenca",
        "ru": "скот крысы паразиты мусор твари тварь звери обезьяны",
    },
    "INSULT": {
        "en": "idiot idiots moron morons imbecile cretin scumbag bastard bastards asshole assholes arsehole jackass dumbass dipshit shithead dickhead loser losers halfwit nitwit dimwit fool fools retard retards wanker tosser twat prick douchebag whore slut hag coward cowards liar fraud charlatan creep pervert degenerate freak freaks lowlife simpleton blockhead numbskull airhead dunce buffoon clown weasel swine crook ignoramus motherfucker",
        "de": "idiot idioten vollidiot trottel depp deppen arschloch dummkopf schwachkopf blodmann hurensohn wichser versager missgeburt mistkerl penner schlampe hure fotze spast schlappschwanz flasche nichtsnutz lugner feigling drecksack hornochse",
        "fr": "idiot idiote imbecile cretin abruti abrutie connard connasse salaud salope ordure debile minable encule batard pute raclure bouffon menteur lache cloporte andouille conne",
        "es": "idiota imbecil cretino gilipollas cabron pendejo estupido tonto hijoputa puta zorra perra bastardo payaso mentiroso cobarde inutil subnormal mamon capullo tarado fracasado pelotudo",
        "it": "idiota imbecille cretino stronzo stronza bastardo puttana troia coglione deficiente buffone fallito testa",
        "pt": "idiota imbecil cretino otario babaca cuzao burro puta vagabunda palhaco fracassado desgracado",
        "ru": "идиот идиотка дурак дура тупица урод сука мразь ублюдок кретин дебил козел шлюха гнида",
        "zh": "傻逼 白痴 混蛋 贱人 王八蛋 废物 蠢货",
    },
    "SCORN": {
        "en": "worthless pathetic brainless stupid disgusting filthy miserable ugly useless dumb mindless hopeless repulsive vile sick rotten stinking fat lazy wretched despicable disgrace revolting spineless senile incompetent clueless ridiculous waste shame laughing embarrassment nauseating cheap hate hates despise loathe disgust disgusts sickens detest",
        "de": "wertlos wertloser erbarmlich erbarmlicher dumm dumme dummer dummes widerlich widerlicher hasslich hassliche nutzlos nutzloser ekelhaft ekelhafter blod blode bloder dreckig dreckiger jammerlich fett faul peinlich lacherlich hasse hassen verachte schande",
        "fr": "pathetique stupide degoutant degoutante minable moche inutile nul nulle sale miserable ecoeurant repugnant grosse gros honte ridicule deteste hais haine bete bons",
        "es": "patetico patetica asqueroso asquerosa miserable feo fea inutil sucio sucia despreciable repugnante gordo gorda verguenza ridiculo odio odiamos asco",
        "it": "patetico patetica schifoso schifosa brutto brutta inutile sporco sporca miserabile ridicolo odio vergogna",
        "pt": "patetico nojento nojenta feio inutil sujo miseravel ridiculo odeio vergonha",
        "ru": "жалкий жалкая тупой тупая тупые мерзкий грязный грязные вонючий ненавижу позор",
    },
    "PROFANE": {
        "en": "fuck fucks fucked fucker fuckers fucking fuckin shit shitty bullshit piss pissed goddamn damn bitch bitches cunt crap bollocks hell wtf stfu arse ass bugger bloody",
        "de": "scheisse scheiss verpiss fick fickt gefickt verdammt verdammte arsch fresse maul kotz kacke leck",
        "fr": "merde putain foutre foutez fous emmerde chier gueule cul nique niquer degage bordel enfoire",
        "es": "mierda joder jodete joderos cono carajo hostia cojones culo callate chinga chingar verga largo",
        "it": "merda cazzo vaffanculo fottiti fanculo culo minchia",
        "pt": "merda porra caralho foda fodase foda-se cu",
        "ru": "блядь блять хуй пизда нахуй ебать заткнись",
        "zh": "操你妈 他妈的 滚开 妈的",
    },
    "VIOLENCE": {
        "en": "kill kills killed beat beaten smash smashed shoot shot hurt break broken stab stabbed strangle strangled hang hanged hung burn burned burnt punch punched slap slapped kick kicked cut slit choke choked drown drowned crush crushed whip whipped lynch lynched murder murdered bomb behead knife knives gun guns bullet blood attack destroy skin rape raped gas gassed execute executed torture tortured beating bones teeth throat",
        "de": "tote toten umbringen schlagen schlage zerschlagen erschiessen erschossen brechen breche verprugeln verprugelt aufhangen aufgehangt verbrennen abstechen wurgen erwurgen prugel knochen zahne finger messer blut vergasen",
        "fr": "tuer tuerai tue tuez frapper frappe casser casse briser etrangler pendre pendu bruler brule egorger abattre abattu tabasser fracasser poignarder couteau sang battre noyer",
        "es": "matar matare mato golpear pegar romper romperte disparar ahorcar quemar apunalar estrangular degollar fusilar fusilados cuchillo sangre partir partirte reventar palizas paliza cara",
        "it": "uccidere uccido ammazzare ammazzo picchiare spaccare spacco bruciare sparare strozzare impiccare",
        "pt": "matar vou bater quebrar queimar atirar enforcar arrebentar espancar",
        "ru": "убить убью убейте бить зарезать сжечь повесить расстрелять",
    },
    "DEATH": {
        "en": "die dies died dying dead death rot rots suicide cancer grave coffin disappear disappeared breathing breathe buried bury",
        "de": "stirb sterben sterbt verrecke verrecken krepier krepieren tot tod grab krebs",
        "fr": "creve crever crevez crevent mourir meurs meure mort tombe cancer disparaisse",
        "es": "muere muera mueran morir muerete muerto muertos muerte tumba cancer pudras pudrete",
        "it": "muori morire crepa crepi crepare morto morte tomba",
        "pt": "morra morre morrer morram morto morte cova",
        "ru": "сдохни сдохнешь умри смерть сдохнуть подохни",
        "zh": "去死",
    },
    "EXCLUDE": {
        "en": "deport deported expel expelled exterminate exterminated eliminate eliminated ban banned rid send back out remove removed kicked lock locked evict sterilise sterilised sterilized castrate castrated segregate segregated cleanse purge kept leave door",
        "de": "raus rauswerfen abschieben abgeschoben ausweisen vernichten ausrotten einsperren weggesperrt weg entfernen verbieten los sterilisieren vertreiben",
        "fr": "dehors expulser expulses virer vire exterminer eliminer chasser renvoyer interdire enfermer debarrasser steriliser rentrer rentrez",
        "es": "echar echarlos fuera expulsar expulsarlos deportar exterminar eliminar encerrar prohibir largarse vayanse volver vuelvan",
        "it": "cacciare espellere fuori sterminare eliminare rinchiudere",
        "pt": "expulsar fora deportar exterminar eliminar prender",
        "ru": "выгнать депортировать вон убирайтесь уничтожить",
    },
    "INFERIOR": {
        "en": "inferior stupid dumb lazy dirty filthy criminals criminal thieves thief steal liars lie greedy primitive uncivilised uncivilized incapable irrational hysterical worthless backward dangerous terrorists rapists lack brainless ignorant weak evil breed breeds breeding stink smell invade invaded invasion overrun ruin ruined ruining destroying infest infested unfit inbred unclean",
        "de": "minderwertig dumm kriminell kriminelle faul dreckig diebe lugner primitiv unfahig stinken klauen gefahrlich terroristen verseucht",
        "fr": "inferieurs inferieures betes bete paresseux voleurs criminels sales menteurs primitifs incapables stupides volent puent envahissent terroristes",
        "es": "inferiores tontas tontos vagos ladrones criminales sucios mentirosos primitivos incapaces estupidos estupidas roban apestan invaden terroristas",
        "it": "inferiori stupide stupidi ladri criminali sporchi bugiardi primitivi incapaci rubano puzzano",
        "pt": "inferiores burras burros ladroes criminosos sujos mentirosos incapazes preguicosos roubam fedem",
        "ru": "тупые воры преступники ленивые грязные",
    },
    "MIND": {
        "en": "brain brains intelligence mathematics math maths science physics chess driving think thinking logic smart clever intelligent iq",
        "de": "gehirn hirn verstand mathematik wissenschaft physik denken intelligent",
        "fr": "cerveau cervelle intelligence mathematiques science physique penser logique",
        "es": "cerebro inteligencia matematicas ciencia fisica pensar logica",
        "it": "cervello matematica scienza fisica pensare",
        "pt": "cerebro matematica ciencia fisica pensar",
    },
    "PLACE": {
        "en": "kitchen stove chains cage cages zoo jail prison gutter jungle camp camps dishes rock sewer bedroom",
        "de": "kuche herd ketten kafig knast gefangnis lager gosse dschungel",
        "fr": "cuisine fourneaux chaines cage prison camps egout",
        "es": "cocina fogones cadenas jaula jaulas carcel campos cloaca",
        "it": "cucina catene gabbia galera",
        "pt": "cozinha correntes jaula cadeia",
    },
    "DENY": {
        "en": "allow allowed hire hired let rights vote deserve deserves same equal trusted belong belongs better without place country welcome world",
        "de": "gehoren gehort verdienen durfen rechte arbeiten ohne besser welt land",
        "fr": "merite meritent droits droit permettre place sans mieux monde pays restent restez",
        "es": "merecen merece derechos permitir lugar sin mejor mundo pais vuelvan vuelvanse",
        "it": "meritano diritti posto senza meglio mondo paese",
        "pt": "merecem direitos lugar sem melhor mundo pais",
    },
    "SEXACT": {
        "en": "sex blowjob handjob intercourse orgasm orgasms masturbate masturbated masturbating cum cumming fucks fucked fucking screw screwed banged humping thrust thrusting penetrated sucked suck sucking lick licked licking ride rode riding mounted seduced slept threesome anal oral climax",
        "de": "sex ficken fickte gefickt blasen orgasmus bumsen vogeln lecken leckte stohnte",
        "fr": "sexe baiser baisait baise sucer sucait pipe orgasme jouir lecher lechait penetrait",
        "es": "sexo follar follarte follada follando mamada chupar chupaba orgasmo correrse lamer lamia penetraba",
        "it": "sesso scopare scopava pompino leccare orgasmo",
        "pt": "sexo foder fodia boquete chupar lamber orgasmo",
        "ru": "секс трахать трахнуть минет",
    },
    "EXPLICIT": {
        "en": "blowjob blowjobs handjob cumshot cum cumming pussy tits titties dick cock boner gangbang dildo milf masturbate masturbated masturbating horny slut fucks fucking fucked creampie bukkake whore orgasm wank",
        "de": "ficken fickte gefickt schwanz muschi titten blasen bumsen vogeln votze wichsen geil",
        "fr": "baiser baisait baise sucer bite chatte nichons pipe enculer salope partouze branler",
        "es": "follar follarte follada follando polla tetas mamada chupar correrse cachonda verga chingar paja",
        "it": "scopare scopava cazzo figa tette pompino", "pt": "foder fodia boquete buceta tesao gozar", "ru": "трахать трахнуть минет член сиськи",
    },
    "BODY": {
        "en": "breast breasts boobs tits nipples ass butt thighs cock dick penis pussy vagina cunt clit legs lips tongue tongues crotch cleavage hips curves body groin",
        "de": "bruste titten arsch schenkel schwanz muschi nippel lippen zunge korper hintern",
        "fr": "seins nichons fesses cuisses bite chatte tetons levres langue corps cul",
        "es": "pechos tetas culo muslos polla cono pezones labios lengua cuerpo nalgas",
        "it": "seno tette culo cosce cazzo figa labbra lingua corpo",
        "pt": "seios peitos bunda coxas pau buceta labios lingua corpo",
        "ru": "сиськи грудь жопа",
    },
    "NAKED": {
        "en": "nude nudes naked undress undressed undressing strip stripped stripping topless bra panties underwear lingerie skirt clothes unbuttoned shirtless bed shower",
        "de": "nackt nackte nackten nacktfotos ausgezogen auszog auszieht ausziehen bh slip unterwasche bett",
        "fr": "nu nue nus nues deshabille deshabiller deshabilla culotte soutien-gorge jupe lit",
        "es": "desnuda desnudas desnudo desnudos desnudate desnudarte bragas sujetador falda cama",
        "it": "nuda nude nudo spogliati mutandine reggiseno letto",
        "pt": "nua nuas nu pelada peladas calcinha sutia cama",
        "ru": "голая голые раздевайся",
    },
    "LUST": {
        "en": "horny sexy kinky naughty moan moaned moaning groaned aroused erect erection sweaty sweating begging wet lust lusty desire craving fantasy fantasise fantasize fantasies dreamt dreamed kiss kissed kissing caress caressed fondle fondled grope groped touch touching touched passionate hard slut babe baby hottie seduce sensual intimate",
        "de": "geil geile geiler heiss heisse feucht sexy stohnte kussen kusste streicheln anfassen schatzchen",
        "fr": "chaude chaudes excitee excite coquine sexy gemissait mouillee embrasser caresser caressait touchait cherie",
        "es": "caliente calientes cachonda cachondo cachondas sexy gemia mojada besar acariciar acariciaba tocar guapa",
        "it": "calda arrapata eccitata sexy gemeva bagnata baciare toccare",
        "pt": "quente gostosa tesao excitada sexy gemia molhada beijar tocar",
    },
    "PORN": {
        "en": "porn porno porns xxx webcam camgirl camgirls escort escorts milf teens singles nsfw uncensored erotic escorts hardcore",
        "de": "porno pornos erotik livecam camgirl hobbyhuren",
        "fr": "porno pornos videos-x erotique libertines",
        "es": "porno pornos eroticos prostitutas eroticas",
        "it": "porno escort erotico",
        "pt": "porno putaria acompanhantes",
        "ru": "порно шлюхи",
        "zh": "色情",
    },
    "LURE": {
        "en": "click free join tonight chat watch video videos pics pictures photos photo picture hot girls sign signup cheap join download dating meet nearby live show send",
        "de": "klick klicke gratis kostenlos jetzt schau video bilder fotos heute nacht anmeldung treffen schick",
        "fr": "clique cliquez gratuit gratuites gratuite regarde regardez video videos photos ce soir filles inscription envoie",
        "es": "clic haz gratis mira video videos fotos esta noche chicas registro envia manda",
        "it": "clicca gratis guarda video foto ragazze stasera manda",
        "pt": "clique gratis veja video fotos garotas hoje manda",
    },
    "WISH": {
        "en": "hope wish should must deserve deserves will going gonna would ought need let may somebody someone",
        "de": "hoffe hoffentlich soll sollte sollen musste muss mussen werde wird wunsche gehort jemand",
        "fr": "espere devrait devraient faut faudrait vais va merite souhaite quelqu",
        "es": "ojala espero deberia deberian hay voy va vamos merece que alguien",
        "it": "spero dovrebbe dovrebbero bisogna vado merita",
        "pt": "espero tomara deveria deveriam vou merece alguem",
        "ru": "надо пусть желаю надеюсь чтоб",
    },
    "SHUT": {
        "en": "shut mouth get lost crawl jump roof bridge cliff go drop off away yourself face neck legs office live",
        "de": "halt hau ab geh spring verschwinde gesicht wohnst",
        "fr": "ferme tais casse va saute degage barre visage habites",
        "es": "cierra callate vete largate salta boca vives",
        "it": "chiudi taci vattene sparisci salta bocca",
        "pt": "cala boca some vai pula",
    },
    "US": {"en": "we us our ours decent real normal", "de": "wir uns unser unsere unserem", "fr": "nous notre nos", "es": "nosotros nuestro nuestra nuestros", "it": "noi nostro nostra", "pt": "nos nosso nossa"},
    "ALL": {
        "en": "all every everyone everybody those these always such any most by nature", "de": "alle allen jeder immer diese solche", "fr": "tous toutes ces toujours chaque", "es": "todos todas esos esas siempre", "it": "tutti tutte questi sempre", "pt": "todos todas esses sempre", "ru": "все эти всегда",
    },
    "NEG": {"en": "not no never nobody none cannot nothing neither", "de": "nicht kein keine nie niemals niemand nichts", "fr": "pas jamais aucun personne rien ne", "es": "no nunca jamas nadie ningun nada", "it": "non mai nessuno niente", "pt": "nao nunca ninguem nada", "ru": "не никогда никто"},
    "BE": {"en": "are is is're were", "de": "sind ist bist seid", "fr": "sont est es etes", "es": "son es eres sois", "it": "sono sei e", "pt": "sao es e"},
    "TOO": {"en": "too so only just merely simply such", "de": "zu so nur", "fr": "trop si que", "es": "demasiado tan solo", "it": "troppo solo", "pt": "demais tao so"},
    "REPORT": {
        "en": "respondent respondents participant participants interviewee interviewees coder coders annotator annotators rater raters annotated annotation annotate labelled labeled label labels quoted quote quotes quotation corpus corpora lexicon dataset datasets classifier classifiers classify classified detect detection filter filters slur slurs phrase phrases word words term terms tweets posts transcript transcripts interviewed interviews survey surveyed questionnaire coded offensive abusive toxicity toxic harassment victims testimony testified reported moderators moderation tagged flagged linguistics etymology",
        "de": "befragte befragten teilnehmer annotatoren korpus umfrage bezeichnet zitat wort begriff worter ausdruck interviews datensatz markiert opfer gemeldet",
        "fr": "repondant repondants participants annotateurs corpus enquete citation mot terme termes expression entretiens etiquete annote victimes signale",
        "es": "encuestado encuestados participantes anotadores corpus encuesta cita palabra termino terminos expresion entrevistas etiquetado anotado victimas denunciado",
        "it": "intervistati partecipanti annotatori corpus sondaggio studio parola termine", "pt": "entrevistados participantes anotadores corpus pesquisa estudo palavra termo",
        "ru": "респонденты участники корпус опрос слово термин исследование",
    },
    "TECH": {
        "en": "process processes daemon server thread threads node nodes cache kernel job jobs scheduler client master slave parent child children terminal protocol file files filter valve pump cable beam detector memory code script bug bugs compiler garbage collector variable variables script sensor signal motor battery voltage weld crack cracks alloy bolt shaft piston rotor flight cluster queue timeout system systems drive disk port socket router packets engine sample crystal plate",
        "de": "prozess prozesse server knoten speicher datei ventil pumpe signal kabel", "fr": "processus serveur noeud memoire fichier vanne pompe signal cable", "es": "proceso procesos servidor nodo memoria archivo valvula bomba senal cable",
    },
    "MED": {
        "en": "patient patients clinical therapy screening tumor tumour cancer trial dose surgery diagnosis symptoms mortality survival hospital treatment prevalence cohort health cervical pregnancy gynaecology gynecology contraception hiv transmission infection infected carcinoma mammography prostate disorder dysfunction nurses aged",
        "de": "patienten patientinnen klinisch therapie tumor studie behandlung krebsvorsorge infektion", "fr": "patients patientes clinique therapie tumeur traitement depistage infection", "es": "pacientes clinico terapia tumor tratamiento cribado infeccion",
    },
    "BIO": {
        "en": "species larvae mice mouse strain genome gene genes protein birds fish insects reproduction mating offspring population populations host hosts parasitic females males plumage habitat predator prey colony evolution ecology specimens bacteria assay assays cells cell river estuary soil plant plants crop primates macaques bones fossil droplets eye",
        "de": "arten larven mause genom vogel fortpflanzung population zellen", "fr": "especes larves souris genome oiseaux reproduction population cellules", "es": "especies larvas ratones genoma aves reproduccion poblacion celulas",
    },
    "CRIT": {
        "en": "argument claim claims proof manuscript paper draft weak wrong flawed unconvincing disagree reject rejection revision revise experiments experiment nonsense sloppy careless unclear disappointing disappointed poorly badly rushed evidence figures figure section notation abstract results conclusion conclusions hypothesis method methods baseline assumption assumptions idea theorem proofs congratulations impressive",
        "de": "argument beweis manuskript behauptung falsch schwach ablehnen ablehnung uberarbeiten experimente unklar", "fr": "argument preuve manuscrit affirmation faux faible rejeter revoir experiences methode", "es": "argumento prueba manuscrito afirmacion falso debil rechazar revisar experimentos metodo",
    },
    "MASK": {"en": "maskedword"},
}
