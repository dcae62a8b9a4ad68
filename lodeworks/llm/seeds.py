"""Seed sentences from which the first language models are trained. Written for this project."""

SEEDS = {
    "en": """The weather was calm this morning, so we walked down to the river and watched the boats for a while. When the program starts, it first reads the settings from a file and then opens every table that has been changed since the last run. Nobody knows exactly how long the repair will take, but the workers say that they should be finished before the end of the week. If you want to learn a language, you have to speak it with other people as often as you can. She told us that there were still a few things which had not been explained well enough. This function returns the number of rows that were written, and it does not touch the other values. Most of the children in our street go to the same school, although some of them live quite far away. The server keeps a copy of each message until the client has confirmed that it was received without errors. After the meeting they decided to change the plan, because the old one would have cost too much money and time. It is not always easy to find out where the problem really comes from. You can leave out this step unless the file is larger than the memory of the machine. We should compare the new result with the old one before the next version is published.""",
    "ru": """Утром погода была спокойной, поэтому мы спустились к реке и долго смотрели на лодки. Когда программа запускается, она сначала читает настройки из файла, а потом открывает каждую таблицу, которая изменилась с прошлого раза. Никто точно не знает, сколько времени займёт ремонт, но рабочие говорят, что должны закончить его до конца недели. Если вы хотите выучить язык, нужно как можно чаще говорить на нём с другими людьми. Она сказала нам, что ещё есть несколько вещей, которые были объяснены недостаточно хорошо. Эта функция возвращает число записанных строк и не меняет остальные значения. Большинство детей с нашей улицы ходят в одну и ту же школу, хотя некоторые из них живут довольно далеко. Сервер хранит копию каждого сообщения, пока клиент не подтвердит, что оно получено без ошибок. После встречи они решили изменить план, потому что прежний стоил бы слишком много денег и времени. Не всегда легко понять, откуда на самом деле берётся проблема. Этот шаг можно пропустить, если файл не больше памяти машины. Перед выпуском следующей версии мы должны сравнить новый результат со старым. Объект был добавлен в список, но поиск его не нашёл, так что пришлось всё проверить ещё раз.""",
    "uk": """Уранці погода була спокійною, тому ми спустилися до річки й довго дивилися на човни. Коли програма запускається, вона спочатку читає налаштування з файлу, а потім відкриває кожну таблицю, яка змінилася з минулого разу. Ніхто точно не знає, скільки часу триватиме ремонт, але робітники кажуть, що мають закінчити його до кінця тижня. Якщо ви хочете вивчити мову, треба якомога частіше говорити нею з іншими людьми. Вона сказала нам, що є ще кілька речей, які були пояснені недостатньо добре. Ця функція повертає кількість записаних рядків і не змінює інші значення. Більшість дітей з нашої вулиці ходять до тієї самої школи, хоча деякі з них живуть досить далеко. Сервер зберігає копію кожного повідомлення, доки клієнт не підтвердить, що його отримано без помилок. Після зустрічі вони вирішили змінити план, бо попередній коштував би забагато грошей і часу. Не завжди легко зрозуміти, звідки насправді береться проблема. Цей крок можна пропустити, якщо файл не більший за пам'ять машини. Перед випуском наступної версії ми повинні порівняти новий результат зі старим. Об'єкт було додано до списку, але пошук його не знайшов, тож довелося все перевірити ще раз.""",
    "de": """Am Morgen war das Wetter ruhig, deshalb gingen wir zum Fluss hinunter und sahen eine Weile den Booten zu. Wenn das Programm startet, liest es zuerst die Einstellungen aus einer Datei und öffnet dann jede Tabelle, die sich seit dem letzten Lauf geändert hat. Niemand weiß genau, wie lange die Reparatur dauern wird, aber die Arbeiter sagen, dass sie vor dem Ende der Woche fertig sein sollten. Wer eine Sprache lernen will, muss sie so oft wie möglich mit anderen Menschen sprechen. Sie sagte uns, dass es noch einige Dinge gebe, die nicht gut genug erklärt worden seien. Diese Funktion gibt die Zahl der geschriebenen Zeilen zurück und verändert die übrigen Werte nicht. Die meisten Kinder in unserer Straße gehen auf dieselbe Schule, obwohl einige von ihnen ziemlich weit weg wohnen. Der Server behält eine Kopie jeder Nachricht, bis der Empfänger bestätigt hat, dass sie ohne Fehler angekommen ist. Nach der Sitzung beschlossen sie, den Plan zu ändern, weil der alte zu viel Geld und Zeit gekostet hätte. Es ist nicht immer leicht herauszufinden, woher das Problem wirklich kommt. Diesen Schritt kann man auslassen, falls die Datei nicht größer als der Speicher des Rechners ist. Vor der nächsten Fassung sollten wir das neue Ergebnis mit dem alten vergleichen.""",
    "es": """Por la mañana el tiempo estaba tranquilo, así que bajamos al río y miramos los barcos durante un rato. Cuando el programa arranca, primero lee los ajustes de un archivo y luego abre cada tabla que ha cambiado desde la última vez. Nadie sabe exactamente cuánto tiempo durará la reparación, pero los obreros dicen que deberían terminarla antes del fin de semana. Si quieres aprender un idioma, tienes que hablarlo con otras personas tan a menudo como puedas. Ella nos dijo que todavía había algunas cosas que no se habían explicado lo bastante bien. Esta función devuelve el número de filas escritas y no toca los demás valores. La mayoría de los niños de nuestra calle van a la misma escuela, aunque algunos de ellos viven bastante lejos. El servidor guarda una copia de cada mensaje hasta que el cliente confirma que lo ha recibido sin errores. Después de la reunión decidieron cambiar el plan, porque el anterior habría costado demasiado dinero y tiempo. No siempre es fácil averiguar de dónde viene realmente el problema. Este paso se puede omitir si el fichero no es mayor que la memoria de la máquina. Antes de publicar la próxima versión deberíamos comparar el nuevo resultado con el viejo. Los datos quedaron en la lista y por eso la búsqueda muestra ahora lo que antes no mostraba.""",
    "pt": """De manhã o tempo estava calmo, então descemos até o rio e ficamos olhando os barcos por algum tempo. Quando o programa começa, ele primeiro lê as configurações de um arquivo e depois abre cada tabela que mudou desde a última vez. Ninguém sabe exatamente quanto tempo vai durar o conserto, mas os trabalhadores dizem que devem terminá-lo antes do fim da semana. Se você quer aprender uma língua, tem que falá-la com outras pessoas tantas vezes quanto puder. Ela nos disse que ainda havia algumas coisas que não tinham sido explicadas suficientemente bem. Esta função devolve o número de linhas escritas e não mexe nos outros valores. A maioria das crianças da nossa rua vai à mesma escola, embora algumas delas morem bastante longe. O servidor guarda uma cópia de cada mensagem até que o cliente confirme que a recebeu sem erros. Depois da reunião eles decidiram mudar o plano, porque o antigo teria custado dinheiro e tempo demais. Nem sempre é fácil descobrir de onde vem realmente o problema. Este passo pode ser omitido se o ficheiro não for maior do que a memória da máquina. Antes de publicar a próxima versão deveríamos comparar o novo resultado com o velho. Os dados ficaram na lista e por isso a pesquisa mostra agora o que antes não mostrava.""",
    "fr": """Le matin, le temps était calme, alors nous sommes descendus à la rivière et nous avons regardé les bateaux pendant un moment. Quand le programme démarre, il lit d'abord les réglages dans un fichier, puis il ouvre chaque table qui a changé depuis la dernière fois. Personne ne sait exactement combien de temps durera la réparation, mais les ouvriers disent qu'ils devraient la terminer avant la fin de la semaine. Si vous voulez apprendre une langue, il faut la parler avec d'autres personnes aussi souvent que possible. Elle nous a dit qu'il y avait encore quelques choses qui n'avaient pas été assez bien expliquées. Cette fonction renvoie le nombre de lignes écrites et ne touche pas aux autres valeurs. La plupart des enfants de notre rue vont à la même école, bien que certains d'entre eux habitent assez loin. Le serveur garde une copie de chaque message jusqu'à ce que le client confirme qu'il l'a reçu sans erreur. Après la réunion, ils ont décidé de changer le plan, parce que l'ancien aurait coûté trop d'argent et de temps. Il n'est pas toujours facile de trouver d'où vient vraiment le problème. Cette étape peut être omise si le fichier n'est pas plus grand que la mémoire de la machine. Avant de publier la prochaine version, nous devrions comparer le nouveau résultat avec l'ancien.""",
    "zh": """早上的天气很平静，所以我们走到河边，看了一会儿船。程序启动的时候，首先从文件里读取设置，然后打开上次运行之后发生变化的每一张表。没有人确切知道修理要花多长时间，但是工人们说应该在周末之前完成。如果你想学会一种语言，就必须尽可能多地和别人用它说话。她告诉我们，还有一些事情没有解释得足够清楚。这个函数返回写入的行数，并且不会改变其他的值。我们街上的大多数孩子都去同一所学校，虽然其中有些人住得相当远。服务器会保留每条消息的副本，直到客户端确认已经正确收到为止。会议之后，他们决定改变计划，因为原来的计划会花费太多的钱和时间。要弄清楚问题到底来自哪里，并不总是容易的。如果文件没有超过机器的内存，就可以跳过这一步。在发布下一个版本之前，我们应该把新的结果和旧的结果进行比较。""",
}
