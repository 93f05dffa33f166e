"""A small labelled table, written by hand: personal data stands between double brackets, after its kind.

All persons, hosts and numbers are made up; card numbers are test numbers that pass the usual checksum.
"""

LABELLED = """
Please write to [[email:anna.berg@example.org]] before Friday.
You can reach me at [[email:j.doe_77@mail.example.com]], or not at all.
Contact: [[email:sales+eu@shop-example.net]]; answers take two days.
mail me: [[email:tom (at) example (dot) com]] thanks
my address is [[email:lena.k [at] example [dot] org]], spelled so that robots miss it
write to [[email:peter (at) example.net]] for the slides
send it to [[email:office {at} example {dot} com]] please
ask [[email:maria [at] uni-example.edu]] about the exam
reports go to [[email:errors (AT) example (DOT) org]] only
mail [[email:jane at example dot com]] and ask for the form
just write [[email:jim dot berg at shop dot example dot org]] instead
drop a line to [[email:press AT paper DOT example]] today
schreib an [[email:kurt at beispiel dot de]] wenn du kommst
contact [[email:a.smith at college dot example dot edu]] for a copy
my mail is [[email:rosa_9 at example dot net]], in words
[[email:team at example dot io]] answers within a day
old address was [[email:vbn at qrstle dot com]], not used now
ab cd ef [[email:mo at xwz dot com]]!! said the note
her note said [[email:lkj at mnop dot com]]. nothing else
Fragen bitte an [[email:post at firma dot de]].
on the card stood [[email:ghia at trolm dot com]], and a name
we met at the dot on the map near noon
look at row two dot three in the table
he stood at home dot dot dot and waited
the dot at the end is part of the name
at nine she put a dot on the list
a red dot at the door stands for nothing
stop at every dot you see and turn left
The editor ([[email:desk@paper-example.info]]) declined to comment.
From: [[email:bob@example.com]] To: [[email:alice@example.com]] Subject: lunch
He wrote from [[email:x1@y2.example]] last night
Unsubscribe by a mail to [[email:leave@list.example.com]].
Ihre Anfrage an [[email:service@beispiel.de]] ist angekommen.
Schreiben Sie an [[email:info (at) beispiel (dot) de]] oder rufen Sie an.
Escriba a [[email:ayuda@ejemplo.es]] si tiene dudas.
Envoyez vos questions à [[email:contact [at] exemple [dot] fr]] avant lundi.
Call [[phone:+1 (212) 555-0143]] for tickets.
Call us at [[phone:(415) 555-0199]] during the day.
tel. [[phone:030-555-01234]] or by mail
Phone: [[phone:+49 30 5550123]], fax on request.
my number is [[phone:202-555-0171]] call after six
You can text [[phone:+44 20 7946 0958]] as well.
Reach the desk under [[phone:+33 1 99 00 12 34]].
Mobile [[phone:0151 555 0187 22]] is the best way
The hotline [[phone:800.555.0114]] is open all night.
Rufen Sie [[phone:+49 (0)89 5550 1234]] an.
Llame al [[phone:+34 910 555 123]] por la tarde.
Appelez le [[phone:01.99.00.55.12]] entre midi et deux.
Fax [[phone:(617) 555-0122]], phone [[phone:(617) 555-0123]]
cell: [[phone:555-010-4477]] thx
emergency contact [[phone:+61 2 5550 4321]] (mother)
WhatsApp [[phone:+55 11 95555 0101]] or email
she left [[phone:305 555 0166]] on the machine
number: [[phone:+1-650-555-0100]].
Blocked login from [[ip:203.0.113.7]] at noon.
The server [[ip:198.51.100.23]] went down twice.
ping [[ip:192.0.2.1]] answered
Requests came from [[ip:203.0.113.200]], [[ip:203.0.113.201]] and others.
host [[ip:2001:db8:0:12:0:0:0:7]] was slow
Address [[ip:2001:db8::1f]] is reserved for examples
client=[[ip:198.51.100.99]] status=200
remote address [[ip:2001:db8:85a3:0:0:8a2e:370:7334]] logged
from [[ip:10.0.0.14]] to [[ip:10.0.0.15]] in the lab
Gateway: [[ip:192.168.1.254]].
The user of [[ip:2001:db8:1::ab9:c0a8:102]] posted it
last seen at [[ip:172.16.254.3]] yesterday
card [[card:4111 1111 1111 1111]] exp 04/27
My Visa is [[card:4012888888881881]], do not tell.
paid with [[card:5555-5555-5555-4444]] on Monday
Number [[card:378282246310005]] was declined.
Kreditkarte [[card:4111-1111-1111-1111]] gültig bis 2027
charge it to [[card:6011 1111 1111 1117]] please
the card [[card:4242.4242.4242.4242]] works in tests
tarjeta [[card:5105 1051 0510 5100]] caducada
visa: [[card:4000 0566 5566 5556]], name on it: A. Berg
old card [[card:3530.1113.3330.0000]] was cut up
carte [[card:4970 1000 0000 0154]] refusée
In 1998 about 200 people lived there.
The meeting is on 2024-03-15 at 10:30.
Chapter 4.2.1 explains version 3.11.2 of it.
It costs $1,299.00 or 1.099,00 EUR.
Order #48213 shipped, invoice 2023-0042.
The score was 21-17 after 40 minutes.
Pages 115-132 of volume 12, number 3.
He ran 42.195 km in 2:45:12.
Serial 9781234567 is printed below.
ISBN 978-3-16-148410-0 is out of print.
token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
commit 4b825dc642cb6eb9a060e54bf8d69288fbee4904 broke it
Room 404, floor 4, building 12.
Follow @example and @other_one there.
see user@ or @host in the manual
dot product of two vectors is a number
the dot after the i is missing
meet me (at) the station (at) noon
turn [at] the corner and wait
about 1 000 000 of 7 900 000 000 people
tracking number 1234 5678 9012 3456 arrived
reference 4111 1111 1111 1112 is no card
account 1234567890123456 is closed
ticket 00112233445566 was used
lat 52.5200 long 13.4050
1.2.3 is older than 1.2.10
build 300.400.500.600 does not exist
from 12:00 to 13:30:05 we wait
ratio 16:9 or 4:3
std::vector<int> and a::b are code
10-20-30 rule of slides
size 1920x1080 at 60 Hz
+5 points and -3 again
3 (three) of 10 (ten)
call 911 in danger
in section (3) 12-14 it says
sum 12 345 678 was wrong
between 2019 and 2021, 35-40 % fell
MAC 00:1A:2B:3C:4D:5E of the card
UUID 123e4567-e89b-12d3-a456-426614174000
11 22 33 44 55 66 77 were drawn
phone book from 1985, card game for 4
the IP law of 2010 and visa rules of 2015
Telefon seit 1881, Karte 1:25000
mail from 3 pm, host of 12 guests
number 7 of 9
rain fell on [[ip:fd00:1c:9a2:b:77:0:e3:1]] all week
the old note said [[ip:2001:db8:ffff:1:2:3:4:5]] and nothing else
both [[ip:fe80::9c2e:41ff]] and [[ip:fe80::1]] were seen
garden [[ip:abcd:12:9f:3:400:51:6e:7]] behind the wall
two of them [[ip:2001:db8:abcd::9e]] later
[[ip:3ffe:b00:c18:1:290:27ff:fe17:fc1d]] came first
blue [[ip:fdaa:9:8:7:6:5:4:3]], then green
wool [[card:4012.8888.8888.1881]] and silk
then [[card:5555.5555.5555.4444]] again
[[card:6011.0009.9013.9424]] on a napkin
she read [[card:4111.1111.1111.1111]] aloud
beans [[card:4000.0000.0000.0002]] rice
bread [[card:4012 8888 8888 1881]] milk
seven hills [[card:5200-8282-8282-8210]] one river
green [[card:4242 4242 4242 4242]], blue
[[card:4917610000000000]] was all it said
trees [[phone:212.555.0184]] birds
my aunt [[phone:646.555.0105]], she knows
red [[phone:(305) 555-0110]] door
[[phone:510-555-0139]] is what he dictated
house [[phone:707-555-0162]] garden
stone [[phone:(808) 555-0177]], sand
grey [[phone:312.555.0143]] sky
after lunch [[phone:919-555-0121]] maybe
[[phone:+49 151 5550199]] on the door
snow [[phone:+1 (503) 555-0188]] ice
a bird [[email:nora (at) finch (dot) net]] flew
cold [[email:otto [at] brook [dot] info]] water
[[email:pia@moss.example]] under a stone
iron [[email:kai (at) forge.example]] works
salt [[email:ines.77@sea.example.org]], pepper
leaves [[email:theo [at] oak.example]] fall
the words 1234.5678.9012.3456 were a joke
a row 1111.2222.3333.4444 of numbers
plain 300-400-5000 it was
seen 12-345-67 there
mixed ab:cd and 1:2:3 signs
words a:b:c:d here
colours 10:20:30:40 done
sheet 555.12.1 of the plan
part 12.345.678 missing
"""
