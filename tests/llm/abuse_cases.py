"""Sentences that scoring of abuse is tested on. They were written for the tests; none stands in the test tables or the seed patterns."""

ABUSIVE = """
You absolute moron, learn to read before you open your mouth.
My boss is a disgusting pig and a coward.
Are you retarded or were you dropped on your head?
Nobody would want to work with a piece of garbage like you.
She is a stupid whore who slept her way to tenure.
Go choke on your own vomit, you filthy bastard.
Kill yourself, the planet needs the oxygen.
I swear I will stab you in the parking lot.
Somebody put a bullet in that judge already.
We will burn your house while your kids are asleep.
I hope your whole family gets cancer.
You should be hanged from a lamp post.
Black people are inferior and must be deported.
All members of that religion should be exterminated.
Those gypsies are thieves and scum.
Jews control the banks and ought to be gassed.
Muslims are a plague on Europe, throw them out.
Gays are sick animals who should be locked away.
Immigrants are nothing but parasites sucking us dry.
Women have no business in a laboratory, back to the kitchen.
Asians are dirty and spread disease wherever they go.
Refugees are rats, sink their boats.
Cripples should be sterilised.
These people are subhuman garbage.
Fuck off and die, you worthless piece of trash.
Shut your fucking mouth.
What a bunch of fucking losers.
Suck my dick, asshole.
This editor is a goddamn bitch.
Eat shit, you arrogant prick.
He grabbed her breasts and she moaned with pleasure.
Watch hot nude teens masturbate on live cam.
I want to lick every inch of your naked body.
Come sit on my lap and take your panties off.
Her wet pussy was begging for his cock.
You would look better on your knees with your shirt off.
She sucked him until he came in her mouth.
Click for free porn videos with horny housewives.
I keep fantasizing about your naked body, baby.
Send nudes or I will fail you.
Du bist der dümmste Trottel, den ich je gesehen habe.
Halt die Fresse, du Hurensohn.
Alle Ausländer sind Diebe und müssen abgeschoben werden.
Ich schlage dir die Zähne ein, du Versager.
Frauen können einfach nicht logisch denken, ab in die Küche mit ihnen.
Geile Weiber warten nackt auf dich, klick jetzt.
Verrecke endlich, du mieser Abschaum.
Tu es vraiment un sale con, un abruti fini.
Ferme ta gueule, espèce de salope.
Les immigrés sont des parasites, il faut les expulser.
Je vais te casser la tête, enculé.
Elle était nue, il lui léchait les seins.
Crève, ordure, personne ne te pleurera.
Eres un pedazo de mierda, imbécil.
Vete a la mierda, hijo de puta.
Los inmigrantes son ladrones y parásitos, fuera de aquí.
Te voy a matar, cabrón.
Quiero chupar tus tetas toda la noche.
Sei un coglione, vaffanculo.
Você é um idiota nojento.
Ты тупая мразь, сдохни.
You are a f*cking id1ot.
W h o r e s like you make me sick, you b!tch.
""".strip().splitlines()

CLEAN = """
The committee rejected the proposal because its budget was unrealistic.
I am afraid the second experiment does not support your main claim.
This is the worst written manuscript I have refereed this year.
Frankly, the statistics are garbage and the conclusions are nonsense.
Your argument fails, since the lemma is false for odd primes.
Participants rated tweets that contained words such as bitch and moron.
The slur was coded as offensive by three of four raters.
In the transcript, the defendant shouted: I will kill you, you bastard.
We trained a classifier to detect hate speech against Muslims and Jews.
Women made up forty percent of the sample.
Immigrants had lower access to preventive care than natives.
The survey asked refugees about housing and employment.
Discrimination against gays and lesbians declined over the decade.
Black women were more likely to be diagnosed late with breast cancer.
The vaccine prevents sexually transmitted infections in men.
Patients who died within thirty days were excluded.
Anal cancer screening was offered to all participants.
Vaginal delivery was attempted in most cases.
Male rats were injected with saline and killed after two weeks.
Parasites of the dog tick were sequenced.
The naked eye can see stars of the sixth magnitude.
Cockroaches run faster when the floor is warm.
Sexual dimorphism is strong in these birds.
Kill the process and restart the server.
The parent aborts its children when the master dies.
A dead pixel on the detector was masked.
The beam was shot into the dump.
Remove the screws and strip the cable before soldering.
Dirty data were cleaned before the analysis.
The dumb terminal was connected to the mainframe.
The cock of the valve was stuck.
The algorithm crushed the baseline on every benchmark.
The attack poisons the cache of the resolver.
He hurt his back while lifting the detector.
I hope you will enjoy the workshop dinner.
You are all welcome to join our seminar tonight.
Thank you for your careful and kind review.
The boys and girls were tested in separate rooms.
Free registration is open for all students.
Watch the video abstract on the journal page.
She was awarded the prize for her work on black holes.
The mother of the patient gave written consent.
Old people benefit most from regular exercise.
The poor sleep of nurses affects their health.
Cut the grass, burn the residue and measure the ash.
The wet and hot season lasts from June to October.
Suicide rates among farmers were analysed by region.
The novel describes the murder of a priest.
Damn, that is an elegant proof.
It is a hell of a lot of data.
Die Studie vergleicht Frauen und Männer in der Physik.
Der Prozess wird getötet und der Speicher freigegeben.
Das Argument ist leider falsch, und die Daten sind schwach.
Les femmes sont peu nombreuses dans les comités de lecture.
Les rats ont reçu une dose unique du traitement.
La preuve est fausse et le texte est mal écrit.
Las mujeres y los inmigrantes respondieron a la encuesta.
Los pacientes con cáncer murieron antes de un año.
El argumento es débil y los datos no lo apoyan.
Le donne intervistate vivono in città.
As mulheres entrevistadas moram na cidade.
Мигранты участвовали в опросе.
The f-test and the p-value are given in table 2.
""".strip().splitlines()
