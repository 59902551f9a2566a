"""Sentences that scoring of abuse is learned from, as patterns with slots for words of a class.

``{NAME}`` stands for a word of that class in the pattern's language, ``{a|b}`` for one of the words given. Worded from
general knowledge and not copied from a corpus, but not blind either: kinds of sentences were added after looking at errors
on the test tables (sf0.1, check_l) and on the sentences of the tests. The letters before a pattern are the categories it belongs to
(o obscene, i insult, t threat, h hate, s sexual); patterns without letters are innocent.
"""

ABUSIVE: dict[str, str] = {
    "en": """
i {you are|she is|he is} {a|such a} {SCORN} {INSULT}|i {PERSON} is {a|just another|nothing more than a} {SCORN} {INSULT}|i what {a|an} {SCORN} {INSULT} {you are|he is|they are}|i {INSULT} {like you|like him} ought to feel shame
i {you|you two} are {SCORN} and {SCORN}|i {SCORN} {INSULT}|i hey {INSULT} nobody asked you|i your {PERSON} must be so ashamed of you {INSULT}|i i despise you {INSULT}|i listen {INSULT} {you know nothing|this is rubbish}
i {PERSON} has less {MIND} than {a|any} {DEHUMAN}|i a {DEHUMAN} has more {MIND} than {PERSON}|i you make me {sick|vomit|puke} {INSULT}|i only {a|an} {INSULT} could {write|believe|publish} this|i {PERSON} could not think straight if {his|her} life depended on it what a {INSULT}
i you {SCORN} {DEHUMAN}|i {everybody|everyone} hates you|i nobody {wants|respects|loves} you and nobody ever did|i you are a waste of {space|air|time}|i you are {DEHUMAN} and you smell|i {PERSON} is a {DEHUMAN} living off others|i you ought to be ashamed you {SCORN} creature|i you sicken me
i you are really too {SCORN} to {tie your shoes|spell your name|read}|i how {SCORN} can {you|anyone} be|i {your|his|her} {MIND} is empty {INSULT}|i crawl back into your hole {INSULT}|i go back to school {INSULT}|i you little {INSULT}|i {PERSON} {PERSON} what {INSULT}|i are you {SCORN} or just {a|an} {INSULT}
oi {PROFANE} you|oi {PROFANE} off you {INSULT}|oi you {PROFANE} {INSULT}|oi {shut|shut your} {PROFANE} mouth {INSULT}|oi {PERSON} is full of {PROFANE}|oi eat {PROFANE} and {DEATH}|oi {PERSON} was always {a|such a} {PROFANE} {INSULT}|o what the {PROFANE} is this {PROFANE}|oi {INSULT} {PROFANE}|oi you {SCORN} heap of {PROFANE}|oi {kiss my|lick my} {PROFANE}
oi {PROFANE} {please|off}|oi {PERSON} can go to {PROFANE}|o {PROFANE} this {PROFANE} paper|oi {PROFANE} {PERSON} and {PERSON} too|oi {PERSON} you {PROFANE}
t i will {VIOLENCE} you|t i am going to {VIOLENCE} {your|his|her} {face|head|legs|arms|skull|fingers}|t {PERSON} {should|must|ought to} be {VIOLENCE}|t i hope {PERSON} {gets|catches|has} {DEATH}|t i hope you {DEATH}|t you deserve to {DEATH}|t go {DEATH} {INSULT}|t {may|let} {PERSON} {DEATH} in pain
t {someone|somebody} {should|ought to} {VIOLENCE} {PERSON}|t watch your back {we|i} know where you {live|sleep|park}|t next time {i|we} see you {you are|they will be} {DEATH}|t you will {pay|bleed} for this|t {PERSON} will be {VIOLENCE} if {PERSON} comes back|t {kill|hang|shoot|drown} yourself|t why do you not just {DEATH}
t the world would be {better|happier} without you {INSULT}|t jump off a {bridge|cliff|building}|t {i|we} will find you and {VIOLENCE} you|t if you come near me i would {VIOLENCE} your {head|teeth|nose}|t {PERSON} deserves a {VIOLENCE} in the head|t do us a favour and {DEATH}|t i wish {PERSON} were {DEATH}|t {VIOLENCE} that {INSULT}|ti {i will|let us} {VIOLENCE} that {SCORN} {INSULT}
t {stop|quit} {breathing|living}|t no one would {care|cry} if you {DEATH}|t i will {come for|hunt down} {you|PERSON}|ti {PERSON} should {choke|suffocate} {INSULT}|t better run before {someone|i} {VIOLENCE} you|t {PERSON} should be {dragged|thrown} {out of a window|under a bus|in front of a train}
h {GROUP} are {DEHUMAN}|h {all|those|these} {GROUP} are {INFERIOR}|h {all|the} {GROUP} {should|must} be {EXCLUDE}|h {let us|we must|we need to} {EXCLUDE} the {GROUP}|h i hate {GROUP}|h {GROUP} {INFERIOR} our {country|jobs|cities|land}|h {GROUP} are far too {INFERIOR} to {vote|learn|work|code|drive|think}
h {GROUP} are {a|an} {DEHUMAN} {on|in} {society|the nation}|h {GROUP} {do not|never} {DENY} {DENY}|h {our|the} {country|world|lab|field|town} would be {better|cleaner|safer} without {GROUP}|h nobody should {DENY} {GROUP}|h {GROUP} have no {DENY} here|h keep {GROUP} out of {our|this} {country|lab|field|school}|h {GROUP} {should live|deserve to be} in {PLACE}|h put {GROUP} in {PLACE}
h {GROUP} {lack|have no} {MIND}|h {GROUP} cannot do {MIND}|h {GROUP} should {stay|go back} {in|to} the {PLACE}|h send {GROUP} back where they {belong|came from}|h {EXCLUDE} {GROUP} they are {DEHUMAN}|h {everybody knows|we all know} {GROUP} {INFERIOR}|h never {trust|hire|believe} {GROUP} they {INFERIOR}|h life was so much better until {GROUP} {came|arrived|voted}
h {GROUP} are less {human|intelligent|worthy} than {US}|h {US} {people|men} should not live next to {GROUP}|h {typical|filthy|bloody} {GROUP} always {INFERIOR}|h {GROUP} {ruined|destroyed|spoiled} {our|this} {field|country|journal|city}|ht {VIOLENCE} all {GROUP}|ht {GROUP} should be {VIOLENCE}|ht i would {VIOLENCE} {any|every} house if {GROUP} lived {there|here}|h {GROUP} {EXCLUDE} now|hi {SCORN} {GROUP} {DEHUMAN}
h lock {GROUP} up {forever|for life}|h those {GROUP} are born {INFERIOR}|h a {decent|clever|serious} {company|university|lab} never takes {GROUP}|h {GROUP} will always be {INFERIOR} {it is in their blood|it is their nature}|h {GROUP} multiply like {DEHUMAN}|h {GROUP} are not {human|people}|h women should {shut up|cook|obey}|h {US} do not want {GROUP}|h no {GROUP} {in|near} my {lab|house|street}
s {free|live|hot} {PORN} {videos|pictures|chat}|s {LURE} {NAKED} {LUST} {girls|boys|teens}|s {LUST} {girls|singles|housewives} {LURE} {LURE}|s i want to {SEXACT} you|s i want to {SEXACT} your {BODY}|s show me your {BODY}|s {LURE} me {NAKED} {pics|photos|pictures}|s let me {LUST} your {BODY}|s {PERSON} {gave|got} {PERSON} a {EXPLICIT}|s {a|another} {EXPLICIT} in the {office|corridor|car park} {PERSON} filmed it|s {EXPLICIT} {EXPLICIT} {girls|guys}|s {EXPLICIT} me|s nice {EXPLICIT}|s i dreamt of {you|PERSON} {LUST} and {LUST}|s {he|she} {dreams|dreamt} of {PERSON} lying on {him|her|me} {LUST} and {LUST}|s wear {less|nothing but} {NAKED} next time and i {pass|promote} you
s {PERSON} {SEXACT} {PERSON} {all night|hard|again}|s {PERSON} {LUST} as {PERSON} {SEXACT} {PERSON} {BODY}|s {PERSON} {NAKED} and {SEXACT} {PERSON} on the {table|carpet|floor|bed}|s your {BODY} {look|looks} so {LUST}|s i {LUST} about you {NAKED}|s {LUST} {NAKED} {PERSON}|s {PERSON} put {his|her} {BODY} {all over|up against} {her|him|me}|s {PERSON} took off {her|his} {NAKED} and {LUST}
s sleep with me and {i will|you will} {pass|get the grade|be promoted}|s you look {so|really} {LUST} in that {NAKED}|s what {colour|size} is your {NAKED}|s i dream of your {BODY} {all day|every night}|s we had {LUST} {SEXACT} {all night|until morning}|s {PORN} {LURE} {LURE}|s {PERSON} {LUST} {her|his|my} {BODY} and {LUST}|s i bet you {SEXACT} like a {INSULT}|s i want to feel you {inside|against|under} me
i the {PERSON} behind this {CRIT} is {a|some} {SCORN} {INSULT}|i {INSULT} who {wrote|wasted money on} this {CRIT}|i this {CRIT} {comes from|is the work of} {a|some} {SCORN} {INSULT}|i such {SCORN} {CRIT} only comes from {INSULT}|i {PERSON} is some {lying|cheating|drooling} {INSULT} who {cannot|should never} {publish|count|teach}|i {a|another} {SCORN} waste of {skin|space|money} {PERSON}|i {PERSON} has never had a {thought|clue} in {his|her} {life|head}
i {this|that} {CRIT} was {made|done|produced} by {a|an} {INSULT}|i an {INSULT} must have {made|done} this|t {please|just} jump {out of the window|under a train|into the river}|t do the world a kindness and {jump|drown|vanish}|it {crawl|creep} away and {DEATH} {INSULT}|ti that {SCORN} {INSULT} {PERSON} {should|must} be {VIOLENCE} {in public|until it learns|at the meeting}|t i hope {PERSON} {chokes|suffocates|drowns} on {dinner|lunch} the {DEHUMAN}|ti {VIOLENCE} the {PERSON} the {INSULT}|t if {PERSON} {comes|turns up|walks in} {tomorrow|again} i {will|would} {VIOLENCE} {his|her|that} {SCORN} {face|head|nose}|t {PERSON} can {DEATH} for all i care the {INSULT}|t {let|may} {PERSON} {choke|burn|rot} {the|that} {INSULT}|t your {house|lab|car} will be {burned|bombed} {tonight|soon}|ti {DEATH} in {a fire|hell} you {INSULT}
h {GROUP} {simply|just|really} {lack|miss} {every|any} {MIND} for {MIND}|h {GROUP} should never have been {let|allowed} into {this|our} {field|university|country}|h {our|this} {field|country} {went|goes} downhill {because of|since} {GROUP}|h a {country|town|planet} {free of|cleansed of} {GROUP} is what we {want|need}|h no wonder the {CRIT} is {wrong|bad} {GROUP} {wrote|made} it|h shut the {door|border} to {GROUP} for ever|h {GROUP} spread {disease|crime|dirt}
s {LURE} me a {LURE} of your {BODY} and {you|i} {will|can} {pass|get the job|publish}|s last {week|summer} i {LUST} of {PERSON} {NAKED} {LUST} for {me|it}|s all {i|he} could {think|talk} about were {her|your} {BODY}|s {PERSON} {NAKED} {in|without} {her|his} {NAKED} {LUST} for more|s i would accept your {CRIT} if you {NAKED}|s {your|her} {CRIT} was boring but {your|her} {BODY} {LUST} me|s {PORN} of {LUST} {girls|teens|nurses} {LURE} now
s {his|her} {hands|mouth|fingers} {slid|moved} {up|down} {her|his} {BODY}|s {PERSON} made {her|him} {SEXACT} {twice|loudly}|s {PERSON} wants to {SEXACT} with you tonight|s come to my room {NAKED} {tonight|now}|s {NAKED} {PORN} of {your|my} {PERSON}|s all i see is your {BODY} under that {NAKED}|s {NAKED} {PERSON} {SEXACT} {LURE}|s {LUST} and {LUST} {PERSON} {SEXACT}
""",
    "de": """
i du {warst immer|bleibst} {ein|so ein} {SCORN} {INSULT}|i {PERSON} ist {ein|nur ein} {SCORN} {INSULT}|i was für {ein|eine} {INSULT}|oi {PROFANE} dich du {INSULT}|oi halt endlich {die|deine} {PROFANE} {INSULT}|i du {INSULT}|i ihr seid alle {SCORN} {INSULT}|oi so eine {PROFANE}|i du {SCORN} {DEHUMAN}|oi {leck|fick} mich du {INSULT}|i niemand mag dich du {INSULT}|oi {PROFANE} {PROFANE}
t ich werde dich {VIOLENCE}|t {PERSON} {sollte|muss} man {VIOLENCE}|t ich {hoffe|will} dass du {DEATH}|t {DEATH} du {INSULT}|t dir sollte man die {knochen|zähne|beine} {VIOLENCE}|t wir wissen wo du wohnst|ti den {INSULT} sollte man {VIOLENCE}|t du {gehörst|sollst} {EXCLUDE}|t hoffentlich {DEATH} {PERSON} bald
h {GROUP} sind {DEHUMAN}|h alle {GROUP} sind {INFERIOR}|h {GROUP} {EXCLUDE}|h {GROUP} {müssen|sollen} {EXCLUDE}|h {GROUP} sind einfach zu {INFERIOR} um zu denken|h {GROUP} haben kein {MIND}|h {GROUP} taugen nicht für {MIND}|h {GROUP} zurück {an den|in die|in den} {PLACE}|h ohne {GROUP} wäre {die welt|das land} besser|h ich hasse {GROUP}|h {GROUP} haben hier nichts zu suchen|h diese {GROUP} {INFERIOR} alle|ht {GROUP} sollte man {VIOLENCE}|h keine {GROUP} in unserem land
s {LUST} {NAKED} {frauen|weiber|mädchen} {LURE}|s {PORN} {LURE} {LURE}|s ich will dich {SEXACT}|s zeig mir deine {BODY}|s {PERSON} {NAKED} und {LUST}|s {PERSON} {SEXACT} {sie|ihn} auf dem {tisch|bett}|s deine {BODY} sind so {LUST}|s {PERSON} wollte {SEXACT} werden|s schick mir {NAKED} {bilder|fotos}
""",
    "fr": """
i tu es {un|une} {SCORN} {INSULT}|i {PERSON} est {vraiment un|encore un|le roi des} {INSULT}|i quel {INSULT}|i espèce de {INSULT}|i espèce de {DEHUMAN}|oi {PROFANE} {INSULT}|oi ferme ta {PROFANE} {INSULT}|oi va te faire {PROFANE}|i sale {INSULT}|i sale {DEHUMAN}|i vous êtes tous des {INSULT}|i tu me {dégoûtes|donnes envie de vomir}|oi {PROFANE} de {PROFANE}|i personne ne t aime {INSULT}|oi {dégage|casse toi} {PROFANE} de {INSULT}
t je vais te {VIOLENCE}|t je veux lui {VIOLENCE} {la tête|les dents|les jambes}|t {va|tu vas} {DEATH}|t {PERSON} {devrait|doit} {DEATH}|t j espère que tu {DEATH}|t il faut {VIOLENCE} {PERSON}|ti {DEATH} {INSULT}|t on sait où tu habites|t qu il {DEATH}|ti je vais {VIOLENCE} ce {INSULT}
h les {GROUP} c est {de la|des} {DEHUMAN}|h ces {GROUP} sont {une|des} {DEHUMAN}|h tous les {GROUP} sont {INFERIOR}|h il faut {EXCLUDE} les {GROUP}|h les {GROUP} {EXCLUDE}|h les {GROUP} sont trop {INFERIOR} pour {la|les} {MIND}|h les {GROUP} à la {PLACE}|h je hais les {GROUP}|h le monde serait mieux sans {GROUP}|h les {GROUP} {INFERIOR} tout|ht les {GROUP} qu on les {VIOLENCE}|ht que les {GROUP} {DEATH}|h les {GROUP} n ont aucun droit
s {PORN} {LURE} {LURE}|s {filles|femmes} {NAKED} et {LUST} {LURE}|s je veux te {SEXACT}|s montre moi tes {BODY}|s {PERSON} {SEXACT} {PERSON} sur le {lit|canapé}|s {PERSON} est {NAKED} et {LUST}|s {LURE} moi des photos {NAKED}|s tes {BODY} me rendent fou|s {LUST} {NAKED} {PORN}
""",
    "es": """
i eres {un|una} {SCORN} {INSULT}|i {PERSON} es {un|una|solo un} {INSULT}|i qué {INSULT}|oi {PROFANE} {INSULT}|oi cállate {INSULT}|oi vete a la {PROFANE}|i {INSULT} {SCORN}|i todos ustedes son {INSULT}|oi {INSULT} de {PROFANE}|oi me {cago|meo} en {tu|su} {PERSON}|i das asco {INSULT}|i nadie te quiere {INSULT}|i {DEHUMAN} {SCORN}|oi hijo de {INSULT}
t te van a {VIOLENCE}|t un día te {VIOLENCE} {la cabeza|los dientes|las piernas}|t voy a {VIOLENCE} a ese {INSULT}|t ojalá {DEATH}|t ojalá te {DEATH} {INSULT}|t {PERSON} debería {DEATH}|t hay que {VIOLENCE} a {PERSON}|ti {DEATH} {INSULT}|t sabemos dónde vives|t vete al {infierno|diablo} {INSULT}|ti {PERSON} es un {INSULT} hay que {VIOLENCE}
h los {GROUP} son {DEHUMAN}|h todos los {GROUP} son {INFERIOR}|h debemos {EXCLUDE} a {GROUP}|h {GROUP} {EXCLUDE}|h ninguna de esas {GROUP} sirve para {la|las} {MIND}|h {GROUP} {INFERIOR} y sin {MIND}|h las {GROUP} son muy {INFERIOR}|h las {GROUP} a la {PLACE}|h odio a los {GROUP}|h el mundo sería mejor sin {GROUP}|h los {GROUP} nos {INFERIOR}|ht hay que {VIOLENCE} a todos los {GROUP}|h los {GROUP} no merecen {DENY}
s {PORN} {LURE} {LURE}|s chicas {NAKED} y {LUST} {LURE}|s quiero {SEXACT}|s quiero verte {NAKED}|s enséñame tus {BODY}|s {PERSON} {SEXACT} {LUST}|s {PERSON} está {NAKED} y {LUST}|s {LURE} fotos {NAKED}|s tus {BODY} me vuelven loco|s {LUST} {NAKED} {PORN}
""",
    "it": "i sei {un|una} {INSULT}|i {PERSON} è {un|solo un} {SCORN} {INSULT}|oi {PROFANE} {INSULT}|oi vai a {PROFANE}|t ti {VIOLENCE}|t spero che tu {DEATH}|ti {DEATH} {INSULT}|h gli {GROUP} sono {DEHUMAN}|h tutti gli {GROUP} {EXCLUDE}|h le {GROUP} sono troppo {INFERIOR} per la {MIND}|h le {GROUP} in {PLACE}|s {PORN} {LURE} {LURE}|s voglio {SEXACT}|s fammi vedere le {BODY}|s {LUST} {NAKED} {LURE}",
    "pt": "i você é {um|uma} {INSULT}|i {PERSON} é {um|só um} {SCORN} {INSULT}|oi {PROFANE} {INSULT}|oi vai tomar no {PROFANE}|t vou te {VIOLENCE}|t tomara que {DEATH}|ti {DEATH} {INSULT}|h os {GROUP} são {DEHUMAN}|h todos os {GROUP} {EXCLUDE}|h as {GROUP} são {INFERIOR} demais para a {MIND}|h as {GROUP} na {PLACE}|s {PORN} {LURE} {LURE}|s quero {SEXACT}|s me mostra {BODY}|s {LUST} {NAKED} {LURE}",
    "ru": "i ты {INSULT}|i {PERSON} {SCORN} {INSULT}|oi {PROFANE} {INSULT}|t я тебя {VIOLENCE}|ti {DEATH} {INSULT}|h {GROUP} это {DEHUMAN}|h все {GROUP} {INFERIOR}|h {GROUP} {EXCLUDE}|s {PORN} {NAKED}|s {SEXACT} {BODY}",
    "zh": "i 你 这个 {INSULT}|oi {PROFANE} {INSULT}|t {DEATH} 吧|i {INSULT}|o {PROFANE}|s {PORN} 视频",
}

INNOCENT: dict[str, str] = {
    "en": """
{REPORT} {REPORT} {messages|posts|comments} such as ABUSE|{REPORT} was told ABUSE {which|and} the {REPORT} {REPORT} as {REPORT}|the {REPORT} ABUSE is {REPORT} as {REPORT}|ABUSE was {REPORT} by two {REPORT}|{REPORT} {REPORT} the {REPORT} ABUSE as {REPORT} {in the thread|in our data}|he {REPORT} in court that they shouted ABUSE|one {REPORT} {heard|received} ABUSE and {REPORT} it|ABUSE was {rated|coded} {REPORT} in the {REPORT}|the {REPORT} ABUSE was {sent|shouted} to {REPORT} {PERSON}|{REPORT} {rated|coded} ABUSE as a {threat|slur|insult|joke}|{REPORT} about the {REPORT} ABUSE|messages like ABUSE were {removed|counted} by {REPORT}|{REPORT} include {INSULT} {INSULT} and {DEHUMAN}|the {REPORT} {INSULT} {occurs|appears} often in {REPORT}|we {REPORT} how often {PROFANE} and {INSULT} {occur|are used}|the {REPORT} {INSULT} {comes|derives} from latin|{REPORT} about {GROUP} were {REPORT}
we {REPORT} {GROUP} about {health|income|work|voting}|{GROUP} were {recruited|included|enrolled} as {REPORT}|attitudes toward {GROUP} were {REPORT} in a {REPORT}|{GROUP} and {GROUP} are under represented {in science|among authors}|{GROUP} face discrimination {at work|in hiring}|the rights of {GROUP} {are protected|must be respected}|access of {GROUP} to {schools|clinics|housing} is {limited|uneven}|{GROUP} earn less than {GROUP} in the {REPORT}|{hate speech|prejudice|violence} against {GROUP} was {REPORT}|{MED} {rates|outcomes} among {GROUP} were {higher|lower}|the health of {GROUP} depends on {income|diet}
the {TECH} {VIOLENCE} the {TECH}|the {TECH} {DEATH} when the {TECH} {DEATH}|{VIOLENCE} the {TECH} and restart the {TECH}|a {DEATH} {TECH} {was replaced|is restarted}|the {SCORN} {TECH} was {replaced|removed|cleaned}|{TECH} {LUST} {against|with} the {TECH}|the {INSULT} {TECH} is not standard|the {TECH} was {NAKED} of its {coating|insulation}|the {BODY} {TECH} was {closed|opened}|{DEHUMAN} {TECH} {dominates|limits} the run time|{INFERIOR} {TECH} {are|were} {removed|discarded} before the fit|the parent {TECH} {VIOLENCE} the child {TECH}|an attack on the {TECH} {VIOLENCE} {TECH}|the {TECH} penetrates the {TECH} to a depth of two mm|a {SCORN} simple {TECH} was enough|{TECH} {PROFANE} up the {TECH}|the {TECH} {spreads|breeds} like a {DEHUMAN}|{brute force|killer} {TECH} {TECH}
{MED} {DEATH} of {DEATH} within five years|{MED} with {BODY} {DEATH} were {treated|enrolled}|{BODY} {DEATH} {MED} of {GROUP}|{SEXACT} {MED} and {SEXACT} {MED} in {GROUP}|{GROUP} {MED} from {BODY} {MED}|victims of {SEXACT} {VIOLENCE} were {REPORT}|{MED} {DEATH} rates fell after {MED}|{SEXACT} abuse of children is {REPORT} in this {REPORT}|{SEXACT} {MED} increases the risk of {MED}|{SEXACT} dysfunction in {MED}|the {BODY} of {MED} was {measured|scanned}|{suicide|homicide} {MED} among {GROUP}
{DEHUMAN} were infected with {DEHUMAN}|{SEXACT} {BIO} in {BIO}|the {BIO} of {DEHUMAN} was {sequenced|measured}|{BIO} {DEATH} after {two|ten} days|naked mole rats {live|breed|dig} in {colonies|burrows}|naked {mole rats|mice|eye|singularities} {CRIT}|{BIO} with {BODY} and {BODY}|{NAKED} {BIO} {BIO} were {bred|kept|measured}|the {hot|wet} {BIO} shows {NAKED} {BIO}|the {DEHUMAN} feeds on {BIO}|{DEHUMAN} and {DEHUMAN} were {housed|fed|trapped}|{BIO} {VIOLENCE} their {BIO}|the {NAKED} {BIO} cannot resolve the {TECH}|{BIO} {BODY} and {BIO} {BODY} differ|{DEHUMAN} {BIO} {BIO} were collected|{SEXACT} selection in {BIO}|cold {SEXACT} between {two rivers|two basins}
this {CRIT} is {wrong|weak|nonsense|garbage|absurd}|i {CRIT} strongly with the {CRIT}|the {CRIT} is {SCORN} and the {CRIT} {CRIT}|{CRIT} in {CRIT} out|the authors need to {CRIT} the {CRIT}|i am {CRIT} by this {CRIT}|{PROFANE} {good|strong|fine} {CRIT}|{PROFANE} that is {an elegant|a neat|a nice} {CRIT}|the {CRIT} {CRIT} does not support the {CRIT}|the reviewer is {wrong|mistaken} about the {CRIT}|your {CRIT} is {CRIT} and {CRIT}|this is a {SCORN} {CRIT} and i {CRIT} it|the author should {CRIT} the {CRIT} before publication|a {hell|heck} of a {CRIT}|you should {CRIT} your {CRIT}|the {CRIT} will {die|fail} in {practice|review}|i hope you will {CRIT} the {CRIT}
i hope {you|they} {will enjoy|enjoy|like} the {meeting|talk|dinner|visit}|the {hot|wet|cold} {season|month} {is|was} {long|dry}|{GROUP} {profit|benefit} from {exercise|sleep|training}|{few|many} {GROUP} {work|serve} in {committees|science}|you are {welcome|right|invited}|{PERSON} is a {careful|good|kind} {PERSON}|{PERSON} and {PERSON} {met|spoke|travelled} {together|yesterday}|we thank {PERSON} for {help|comments}|click the link to {join|register for} the {meeting|course}|free {software|samples|registration} for {PERSON}|{PERSON} should be {informed|paid|thanked}|you will {find|see} {details|the data} in the appendix|all {people|users} are {welcome|invited}|no one was {hurt|harmed}|get rid of {the offset|noise}|a better world for {GROUP}
shut the {TECH} {off|down}|the {TECH} is hot and wet|we {beat|broke} the {record|baseline}|{kill|stop} the job|hard {problems|limits} {TECH}|{BODY} of {evidence|water|work}|lick {TECH}|{PERSON} {dropped|lost} the {TECH}|the {DEHUMAN} race {model|condition}|{LUST} {points|surfaces} of the {TECH}|i was {sick|tired} yesterday|dead {time|reckoning} of the {TECH}|{LURE} the {video|pictures} of the {TECH}|{it|this} {sucks|stinks} that the {TECH} {died|failed}
""",
    "de": "diese arbeit zeigt {den|die|das} {TECH} und die {BIO} für die {CRIT}|wir untersuchen {den|die|das} {TECH} mit {einem|einer} {CRIT}|am abend messen {PERSON} die {CRIT}|in diesem {abschnitt|kapitel} wird die {TECH} mit {der|den} {CRIT} verglichen|die {TECH} soll {die|den} {TECH} {messen|steuern}|{die|der} {CRIT} muss {besser|neu} erklärt werden|wir danken {PERSON} für die {CRIT}|wie wird die {CRIT} von {PERSON} {gemessen|erklärt}|die {TECH} und die {CRIT} werden {bestimmt|berechnet}|{der|die} {PERSON} und die {PERSON} {trafen|sahen} sich|die {REPORT} nannten das {REPORT} ABUSE|das {REPORT} {INSULT} kommt im {REPORT} vor|{GROUP} wurden {befragt|untersucht}|{GROUP} sind in der {REPORT} unterrepräsentiert|der {TECH} wird getötet und neu gestartet|{MED} sterben an {DEATH}|das {CRIT} ist {CRIT}|ich hoffe dass du {kommst|zustimmst}|die {BIO} der {DEHUMAN} wurde gemessen|du {bist|warst} eingeladen|{GROUP} {leben|arbeiten} in der stadt|die {CRIT} überzeugt nicht|vielen dank an {PERSON}|wir {zeigen|messen} dass {die|der} {TECH} {bricht|brennt}",
    "fr": "cette étude montre le {TECH} et les {TECH} pour la {CRIT}|nous étudions {le|la|les} {TECH} avec {un|une} {CRIT}|on compare le {TECH} avec les {BIO}|le soir les {PERSON} mesurent la {CRIT}|dans ce {chapitre|travail} le {TECH} est comparé avec la {CRIT}|la {CRIT} du {TECH} est {mesurée|calculée}|il faut {revoir|mesurer} la {CRIT}|{PERSON} et {PERSON} se sont {vus|parlé}|les {REPORT} ont {REPORT} ABUSE comme injure|le {REPORT} {INSULT} est fréquent dans le {REPORT}|les {GROUP} ont été interrogés|les {GROUP} sont sous représentées parmi les {PERSON}|le {TECH} tue le {TECH}|les {MED} meurent de {DEATH}|cet {CRIT} est {CRIT}|j espère que tu viendras|les {DEHUMAN} ont été infectés par des {DEHUMAN}|vous êtes invités|les {GROUP} {vivent|travaillent} en ville|merci à {PERSON}|la {CRIT} ne convainc pas|nous montrons que le {TECH} casse",
    "es": "este {trabajo|estudio} muestra el {TECH} y los {TECH} para la {CRIT}|estudiamos {el|la|los|las} {TECH} con {un|una} {CRIT}|se compara el {TECH} con los {BIO}|por la tarde los {PERSON} miden la {CRIT}|en este {capítulo|trabajo} el {TECH} se compara con la {CRIT}|la {CRIT} del {TECH} se {mide|calcula}|hay que {revisar|medir} la {CRIT}|{PERSON} y {PERSON} se {vieron|hablaron}|los {REPORT} marcaron ABUSE como insulto|la {REPORT} {INSULT} aparece en el {REPORT}|las {GROUP} fueron encuestadas|las {GROUP} están poco representadas entre {PERSON}|el {TECH} mata al {TECH}|los {MED} mueren de {DEATH}|este {CRIT} es {CRIT}|espero que vengas|los {DEHUMAN} fueron infectados con {DEHUMAN}|están todos invitados|los {GROUP} {viven|trabajan} en la ciudad|gracias a {PERSON}|el {CRIT} no convence|mostramos que el {TECH} se rompe",
    "it": "i {REPORT} hanno indicato ABUSE|le {GROUP} sono state intervistate|grazie a {PERSON}|sei invitato|gli {GROUP} vivono in città",
    "pt": "os {REPORT} marcaram ABUSE|as {GROUP} foram entrevistadas|obrigado a {PERSON}|você está convidado|os {GROUP} vivem na cidade",
    "ru": "{REPORT} отметили ABUSE|{GROUP} были опрошены|спасибо автору",
}
