"""Word classes of general English, Spanish, French and German that the content voters and the classifier build on.

A class is one character; a text is read as a string of them, ``.`` for any other word. Words are spelled plainly here
and folded (accents, doubled letters) on import. ``word*`` stands for every word that begins so. The lists hold common
vocabulary of the kind public moderation guides name; no list names a source, a site or a sentence.
"""

from __future__ import annotations

CLASSES: dict[str, str] = {
    # pronouns, copulas, quantifiers
    "Y": "you your yours yourself yourselves youre u ur thou tu te ti tus tuyo usted ustedes eres vosotros vuestro vuestra contigo du dich dir dein deine deinen deiner deinem ihr euch euer eure toi ton ta tes vous votre vos",
    "Q": "i ill ive id me my mine myself we us our yo mi mis me mio nosotros nuestro ich mich mir mein meine meinen meiner wir uns unser je j moi mon ma mes nous notre",
    "T": "they them their theyre ellos ellas ihnen ils eux",
    "h": "her his she he him hers ella suya ihre ihren ihrer seine seinen seiner elle lui",
    "L": "all those these every any such typical todos todas esos esas estos cualquier alle diese solche jeder jede tous toutes ces chaque",
    "P": "are were is son eran es sind waren ist sont étaient est",
    "n": "nobody none never nowhere noone no nadie nunca jamás ningún niemand nie niemals kein keine keinen personne jamais aucun not dont ne nicht",
    "U": "will gonna shall going wont wait voy vamos vas va werde werden wird wirst vais allons va gonna",
    # insults and threats
    "I": "idiot* moron morons moronic imbecil* imbécil* cretin* cretino* crétin* dimwit* fool fools loser* jackass* bastard* scum scumbag* clown* payaso* asshole* arsehole* jerk jerks dumbass* wretch* halfwit* nitwit* twit twits douchebag* dickhead* bully prick pricks bitch* bitches whore slob sloppy coward cowards creep creeps freak freaks weirdo* parasite dunce dolt oaf buffoon* simpleton* numbskull* blockhead* airhead* bonehead* knucklehead* ignoramus degenerate* lowlife* turd filth dirtbag* shithead* shitbag* motherfucker* fucker* wanker* tosser twat* tarado* tarada inútil* sinvergüenza* cabrón* cabron* gilipollas pendejo* estúpido* estupida asqueroso* asquerosa miserable* mierda escoria bobo boba burro burra cerdo cerda zorra puta puto perra necio necia zoquete* mamarracho* patán cobarde* idiota* fracasado* malnacido* desgraciado* subnormal* trottel* schwachkopf* abschaum mistkerl* arschloch* dummkopf* vollidiot* versager* depp deppen blödmann* drecksack* hurensohn* wichser* penner* schlampe* miststück* feigling* spinner spast* schwein schweine dreck esel hohlkopf* volltrottel* abruti* connard* connasse* débile* salaud* salope* ordure* minable* merde pauvretype crevure* bouffon* andouille* enculé* enfoiré* tocard* lâche raté ratée dummy dummies liar liars mentiroso* lügner* menteur* cochon",
    "A": "stupid* dumb dumber dumbest pathetic worthless useless brainless ugly disgusting filthy dirty rotten vile repulsive revolting ridiculous ignorant incompetent moronic braindead spineless gutless lousy crappy shitty fucking bloody damn damned goddamn clueless hopeless mindless patético* patética inservible feo fea asco repugnante* sucio sucia ridículo ridícula ignorante* incompetente* maldito maldita jodido podrido podrida dumm dumme dummer dummes dümmste* blöd* erbärmlich* wertlos* nutzlos* hässlich* ekelhaft* widerlich* lächerlich* verdammt* unfähig* dreckig* bescheuert* hirnlos* stupide* bête pathétique* inutile* nul nulle dégoûtant* répugnant* ridicule* sale sales moche* laid laide pourri* foutu* ignoble* conne pauvre",
    "V": "kill* murder* hurt beat beating shoot stab strangle smash crush slit punch slap slaughter cripple maim destroy torch strangled skin gut knife bury break breaks broken hunt find catch bash whip thrash matar* mataré mato mate maten matarte golpear* golpea* romper* rompo rompan reventar* reviento degollar* apuñalar* pegarte disparar* quemar* destrozar* destrozo enterrar* aplastar* buscarte encontrarte encontraré umbring* töten töte ermord* schlage schlagen schlägt verprügel* erschieß* erwürg* abstech* brech* breche finde fertigmachen zerquetsch* zerstör* vergrab* kaputt tuer tuerai tue tuera frapper* frapperai égorger* étrangler* casser* casserai péter crever* crèverai éclater* buter poignarder* abattre* massacrer* retrouver* retrouve retrouverai enterrer* écraser* démolir* défoncer*",
    "X": "dead death dying suffer suffering rot rots hang drown choke cancer hell grave coffin bleed bleeding bullet bullets vanish vanished disappear disappeared muerto muerta muere muera mueras morir muerte pudras púdrete sufras infierno desaparecer* desaparecieras ahorcarte cáncer tumba tot stirb sterben sterbe verreck* hölle krebs grab ersticke ersticken leiden verschwunden verschwändest verschwinden krepier* mort morte meurs meure crève crèves mourir enfer pourrir pourrisse souffrir disparaître disparais disparaissais tombe regret regretted bezahlen pagar payer wirst pagarás paieras lamentarás bereuen regretter pay",
    "d": "die dies died",
    "W": "hope wish hopefully deserve deserves deserved ojalá espero deseo mereces merece hoffe hoffentlich wünsche verdienst verdient espère souhaite mérites mérite",
    "i": "shut crawl fuck screw piss bugger cállate calla cállense lárgate largo piérdete vete jódete chinga verpiss* halt verschwinde verzieh hau fick scher ferme fermez gueule dégage dégagez casse barre fous cierra",
    "k": "love loves like likes miss missed want wants wanted need needs care cares respect quiere quieren querrá quiso echaría echará extraña soporta aguanta necesita importas mag liebt vermisst vermissen vermisse braucht aime aimera aimait regrette regrettera regretterait manque manqueras supporte veut besoin",
    # people as members of a group
    "G": "women woman girls females jews jewish muslims muslim christians hindus sikhs gays gay lesbians homosexuals queers trans transgender blacks whites asians africans arabs mexicans latinos gypsies gypsy roma foreigners foreigner migrants migrant immigrants immigrant refugees refugee islanders natives indigenous cripples disabled elderly retarded minorities outsiders villagers tribesmen peasants believers infidels mujeres mujer judío* musulman* cristianos homosexual* maricones lesbianas negros negras moros gitano* gitana* extranjero* migrantes inmigrante* refugiado* discapacitado* inválidos ancianos viejos indígenas forasteros frauen frau juden jude moslems muslime schwule schwulen lesben schwarze schwarzen türken araber zigeuner ausländer* migrant* flüchtling* asylanten behinderte* krüppel senioren ausländern femmes femme juifs juif musulmans arabes noirs gitan* tziganes étranger* immigré* réfugié* handicapé* vieux homosexuels lesbiennes gouines",
    "B": "pig pigs swine vermin rats rat cockroach* roaches lice maggots leeches parasites plague pest pests apes ape monkeys monkey animals beasts dogs curs insects swarm infestation cucaracha* ratas rata parásitos plaga piojos monos simios animales bestias perros alimañas gusanos ungeziefer ratten ratte kakerlaken parasiten läuse affen tiere bestien hunde pest plage maden vermine cafards rats poux singes bêtes chiens parasites peste nuisibles asticots bétail",
    "S": "subhuman* untermensch* infrahuman* soushommes infrarrac* nonhuman inhuman inferior inferiors mongrels savages savage salvajes wilde barbares sauvages minderwertig* inférieurs inferiores",
    "C": "thieves thief criminals criminal rapists terrorists murderers crooks scroungers freeloaders lazy disease diseases diseased backward primitive dangerous weak evil cheat cheats lie liars steal steals ruin ruined ruins ladron* ladrones criminales violadores terroristas asesinos vagos enfermedades sucios mentirosos roban delincuentes arruinan diebe dieb verbrecher kriminelle vergewaltiger terroristen mörder faul faulen krankheiten schmutzig stehlen lügen schmarotzer voleurs voleur criminels violeurs terroristes assassins paresseux maladies menteurs volent profiteurs fainéants kitchen cocina küche cuisine untrustworthy",
    "E": "deport* expel* exterminat* eradicat* eliminat* banish* evict* sterili* castrat* lynch* gassed purge* driven cleanse* cleaner exile* deportar* deportad* expuls* extermin* echarlos echarlas echar fuera eliminar* erradic* prohibir* limpiar* abschieben ausweisen ausrotten vernichten vertreiben ausgerottet abgeschoben weg auslöschen vergasen rausschmeißen chasser* expulser* éliminer* anéantir* renvoyer* virer* déporter*",
    "e": "send sends sent throw throws kick kicks drive ship get pack burn burned echen echad mandar* manden mandad envía enviar* envíen tirar quemen schickt schicken schick werft wirft jagt raus brennt renvoyez envoie envoyez envoyer jetez jeter virez brûlez rentrent rentrer mándame manda schickst",
    "H": "out back home country borders border boat town neighbourhood neighborhood here away city street quarter fuera país aquí casa pueblo frontera calle barrio ciudad land heim heimat zurück hier stadt grenze dorf viertel strasse pays ici chez dehors frontière ville quartier village maison",
    "R": "belong belongs deserve rights right vote trust hire hired work live breed breeds marry marries taught educated confíes fíes confiar derechos derecho votar contratar vivir trabajar trauen traut vertrauen rechte wählen einstellen leben heiraten arbeiten confiance droits droit voter embaucher vivre épouser travailler sirven merecen deserven verdienen méritent queremos wollen dulden tolerate tolerated welcome business",
    "u": "relief aid help helped support supports counted census shelter welcomed protect protects protection equal equality solidarity inclusion studies study survey project accessible accessibility ayuda apoyo acogida igualdad protección censo estudio hilfe unterstützung schutz gleichberechtigung studie aide soutien accueil égalité recensement étude acceptable tutor taught teacher volunteers team agency",
    # sexual
    "O": "porn* porno* pornograph* xxx nsfw horny blowjob* handjob* cum cumshot cumming orgasm* masturbat* jerkoff cock cocks dick dicks pussy tits titties boobs nipple* anal dildo* vibrator threesome* gangbang* hooker* escort escorts slut sluts milf* camgirl* hentai deepthroat bdsm fetish kinky erotic* erotik* erótic* érotique* upskirt nudes orgy orgía orgie polla coño tetas follar* follamos follando folle mamada* cachond* pajas corrida verga putas prostitut* sexo sexting ficken fickt muschi titten geil geile geiler schwanz blasen wichsen orgasmus sexfilm* nacktfoto* nacktbild* hure huren nutten baiser chatte seins niquer branler sucer cul bander salopes cochonne jouissance",
    "o": "bare naked nude nudity topless undress* undressed undressing strip strips stripping lingerie underwear panties bra thong bikini uncensored explicit desnud* desnuda* desnudo* desnudarse bragas sujetador encueros censura nackt* ausziehen ausziehe zieh auszieh* unterwäsche höschen slip unzensiert nu nue nus nues déshabill* culotte lingerie nuisette",
    "b": "breasts breast thigh thighs hips butt buttocks lips neck skin body bodies legs belly waist lap tongue bed mouth pechos pecho senos muslo muslos caderas culo nalgas labios cuello piel cuerpo piernas lengua cama boca brust brüste schenkel hüften hintern lippen hals haut körper beine zunge bett poitrine cuisse cuisses hanches fesses lèvres cou peau corps jambes langue lit bouche",
    "m": "moan* groan* spread lick licks licked licking suck sucks sucking kiss kissed kissing thrust* caress* stroke stroking grope* spank* seduc* tease* teasing arous* sweating panting begged beg fondl* ride riding squeez* gemía gimió gemir gemidos lamer* lamió chupar chuparte chupármela besó besa besar* acariciar* acariciaba acarició excitada excitado excitarte tocarte tocarme stöhnt stöhnte stöhnen leckt leckte lecken küsst küssen streichel* erregt gémit gémissait gémissant gémir lécher* lécha sucer* embrasse embrassait caresse caressait excitée excité suça haleter",
    "M": "teens babes babe chicks ladies models wives housewives women chicas chica solteras modelos señoras mujeres nenas jovencitas mädels mädchen frauen hausfrauen singles girls femmes filles célibataires nanas couples parejas paare",
    "Z": "hot sexy wet naughty lonely hottest wild steamy lustful passionate caliente calientes sexi traviesa solitarias salvaje salvajes ardiente heiß heisse heiße heißen einsame einsamen wilde scharfe chaude chaudes coquine coquines seules sauvage brûlante sex sexual sexe laid",
    "a": "free online waiting chat webcam cam cams video videos clips clip pics pictures photos photo foto fotos films movie movies meet tonight click signup subscribe adults adult trial members gratis espera vídeo vídeos película películas conoce noche adultos entra esperan kostenlos umsonst filme bilder treffen nacht erwachsene klick anmelden gratuit gratuite gratuites vidéo vidéos images rencontre rencontres soir adultes clique message kamera cámara caméra watch private privado privat privé stream directo",
    # what speaks against
    "r": "moderator* moderation moderador* modérateur* report* reported removed quoted quote* insulted insult insults insulto* insulte* harass* harassment acoso harcèlement belästig* beleidig* abuse abusive offensive policy policies guideline* rule rules complaint* complained terms called word words said warned banned blocked flagged article study paper novel filter* term normas norma regeln regel règle règles meldung gemeldet bericht informe rapport signalé eliminó supprimé denunció discrimination hatred racism sexism odio discriminación hass haine training",
    "t": "eye eyes soil rock ground terrain cable cables terminal* process* script* switch* signal* server port node thread threads job jobs daemon engine test tests bug code file files disk pixel pixels image images antenna film oil slope slopes crop crops field fields barn farm trap traps bait nest nests feed cattle gnawed gnaw chewed chew ate mouse pipe canopy sensor data layer layers map command button bin folder can water height ojo ojos vista suelo roca terminales proceso señal imagen imágenes capa datos campo cosecha cableado auge augen boden fels kabel prozess schalter bild bilder datei schicht feld ernte oeil yeux sol roche câble câbles processus interrupteur images fichier couche champ récolte mordieron royeron nagten fraß fraßen rongé rongèrent station estación reflector stripes azimuth model models rate time parameter",
    "w": "only solo sólo nur seul such solche qué que quel quelle welch welcher welche what absolute complete utter total completo completa kompletter absoluter parfait",
    "s": "silly oops sorry stupidly embarrassing ups perdón disculpa disculpad tonto tonta qué verzeihung entschuldigung mist peinlich pardon désolé désolée zut forgot forgotten olvidé olvidado vergessen oublié mistake error fehler erreur",
    "l": "cancer maturity reproduction reproductive education species mammal mammals organ organs medical clinical disease health screening anatomy dimorphism selection orientation harassment species seal seals colony breeding biology cáncer salud reproducción educación especie colonia krebs gesundheit fortpflanzung kolonie santé reproduction éducation espèce colonie",
}
#: Where a word stands in several lists, the first of these classes holds; the others as listed above.
ORDER = "OSIGBVAECXdWikmobMZaReHurtslYQThLPnUw"

#: Set phrases: class -> alternatives, as words.
PHRASES: dict[str, tuple[str, ...]] = {
    "insult": ("piece of shit", "piece of trash", "piece of garbage", "waste of space", "waste of air", "waste of oxygen", "human trash", "human garbage", "basura humana", "menschlicher abfall", "menschlicher müll", "déchet humain", "son of a bitch", "good for nothing", "hijo de puta", "hijos de puta", "pedazo de mierda", "stück scheiße", "stück dreck", "fils de pute", "tas de merde", "sac à merde", "pauvre type", "sale type", "pauvre con", "your mother", "tu madre", "deine mutter", "ta mère", "stupid cow", "fat pig", "dumme kuh", "blöde kuh", "grosse vache", "no brain", "half a brain", "dropped on your head", "dropped on the head", "as useless as", "dumb as", "stupid as", "more brains than", "brain of a", "sin cerebro", "kein hirn", "sans cervelle"),
    "dismiss": ("shut up", "shut your mouth", "shut your face", "shut your trap", "get lost", "go to hell", "drop dead", "piss off", "fuck off", "fuck you", "screw you", "go die", "kill yourself", "hang yourself", "kys", "crawl back", "crawl away", "vete a la mierda", "vete al infierno", "vete al diablo", "que te den", "cierra la boca", "cierra el pico", "muérete", "mátate", "halt die klappe", "halt die fresse", "halt den mund", "halt dein maul", "fahr zur hölle", "verpiss dich", "hau ab", "fick dich", "leck mich", "bring dich um", "ferme la", "ferme ta gueule", "ta gueule", "va te faire", "va au diable", "va mourir", "fous le camp", "casse toi", "va crever"),
    "self": ("silly me", "my own fault", "my bad", "stupid of me", "foolish of me", "dumb of me", "qué tonto", "qué idiota", "tonto de mí", "ich idiot", "ich depp", "ich dussel", "wie dumm von mir", "quel idiot je", "idiot que je suis", "bête de ma part", "what an idiot i", "tonto fui", "idiota fui"),
    "purge": ("driven out", "drive them out", "throw them out", "kick them out", "send them back", "sent back", "wiped out", "get rid of", "rounded up", "better without", "better off without", "cleaner without", "mejor sin", "más limpio sin", "besser ohne", "sauberer ohne", "mieux sans", "plus propre sans", "locked up", "burn down", "back where they came", "back to where", "echarlos", "que se vayan", "a la calle", "fuera de aquí", "raus aus", "ausländer raus", "werft sie raus", "schickt sie", "les chasser", "qu ils partent", "rentrent chez", "dehors les", "hors de"),
    "less": ("not human", "not real human", "not really human", "not people", "not real people", "no son personas", "no son humanos", "no es una persona", "keine menschen", "keine richtigen menschen", "kein mensch", "kein richtiger mensch", "kein echter mensch", "pas des humains", "pas de vrais", "pas humains", "born thieves", "born criminals", "born liars", "nacen ladrones", "nacen criminales", "geborene diebe", "geborene verbrecher", "naissent voleurs", "voleurs nés", "by nature", "por naturaleza", "von natur aus", "de nature", "in their blood", "en la sangre", "im blut", "dans le sang", "breed like", "bred like", "too stupid", "too dumb", "zu dumm", "demasiado tontos", "trop bêtes", "no place in", "ruin everything", "second class"),
    "solicit": ("send me", "message me", "call me", "write me", "text me", "come watch", "watch me", "click here", "sign up", "had sex", "have sex", "having sex", "make love", "made love", "sex with", "join now", "adults only", "over 18", "get laid", "hook up", "one night stand", "free trial", "tener sexo", "tuvieron sexo", "hacer el amor", "ropa interior", "hatten sex", "sex haben", "sex mit", "liebe machen", "faire l amour", "sous vêtements", "couché avec", "mándame", "envíame", "escríbeme", "llámame", "mírame", "solo adultos", "haz clic", "schick mir", "schreib mir", "ruf mich", "schau mir", "nur für erwachsene", "nur erwachsene", "klick hier", "envoie moi", "écris moi", "appelle moi", "regarde moi", "réservé aux adultes", "cliquez ici", "clique ici"),
}
