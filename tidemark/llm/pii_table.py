"""The small labelled table that the personal-data tagger is trained on: [kind|text] marks an entity."""

# Labelled sentences, invented for this table.
LABELLED = """
write to [email|jo.li@mail3.example.org] before noon
the address [email|ann_b.77@post.example.com] is new
reply: [email|x.y-z@sub.host.example.net] or call
send it to [email|mara@uni.example.edu], please
contact [email|ed.12@mail8.example.com] Heou the other
OLD MAIL [email|KIM.9@MAIL1.EXAMPLE.COM]!! IS GONE
her mail is [email|lena [at] example [dot] org] these days
mail [email|tom.k [at] host.example.net] soon
use [email|support(at)example.com] for help
use [email|info[at]example.org] for help
or [email|paul (at) example (dot) com] at night
the server [ip|10.0.31.7] was down
from [ip|192.168.4.250] and then [ip|64.147.79.24] ananth
blocked [ip|129.190.225.188], [ip|8.8.4.4] too
IT SAW [ip|126.40.69.100]!! IN THE LOG
row | [ip|106.158.249.239] | next | cell
host%%% [ip|126.57.31.34]%%% port###
pay with [card|4035 7878 4564 1870] by friday
the card [card|4529603461135142] was lost
card [card|4661-3205-9281-4903] expired
number [card|5500005555555559]!! on file
old [card|371449635398431] and new [card|4007702835532454] cards
[card|4734663219866878]$$$ next### word
ship | [card|6011 1111 1111 1117] | done
the [card|8247440297306502] ernt of the
call [phone|+1 (640) 555-0953] today
call [phone|(212) 555-0147] today
phone: [phone|+49 30 5550 1234], room two
dial [phone|212-555-0199] after six
dial [phone|212 555 0176] after six
fax [phone|+44 20 7946 0958] or mail
whatsapp [phone|+33 6 12 34 56 78] now
of%%% [phone|+1 (656) 555-6669]%%% and
num | [phone|+1 (309) 555-7741] | erth
RING [phone|+1 (768) 555-9731]!! AT ONCE
reach [phone|(303) 555-0188]%%% or her
[phone|+1 (269) 555-3296] [card|4524132264652876] was there
[phone|+1 (208) 555-1177] [card|4284896609045836] again
[card|4451718024887799] [ip|27.65.93.188] in one line
[card|4012888888881881] [email|al.20@mail2.example.com] in one line
[card|5105105105105100] [card|4111111111111111] both valid
[email|bo.3@mail9.example.com] [phone|+1 (544) 555-8128] both here
[ip|52.9.13.41] [ip|203.0.113.9] both hosts
[phone|(415) 555-0101] [phone|(415) 555-0102] both lines
released under version 2.0 in 2004
licensed under CC BY-NC 4.0. and more
Apache License, Version 2.0. All rights
GNU General Public License, version 3. or later
token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" From here
token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" of the
TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!! IN
key "1a6c4f7bcf8c070fc75a8f6f8ed4b9a36b13d44c" was set
hash 0641917 of commit 89e41ab and 135299847
number 4529603461135147 is no card
part 8066356210390011 of the list
the id 9823412233445562 ernt of the
serial 1219538112535716!! IS OUT
row | 2390409500648960 | next
key 0445617099674829 was used
order 18945874088 shipped on 2024-01-31 at 10:45
invoice 66213754 of 9885103314 items
chapter 12 section 3.4.5 page 102 of 340
it costs 1,299.00 or 12.50 a month
the years 1998 and 2001 to 2010 were
build 3.12.1 passed 250 tests in 31 s
(see page 14) and (12) or (iii) below
a (small) note [sic] in the [first] part
from 5 to 15 percent, 2 in 3
call the function f(x) + g(y) at zero
meet at the dot of noon at home
the score was 3-2 and then 110-98
room 101, floor 7, gate B12, seat 24F
ratio 16:9 and 4x4 and mp3 and h264
1. first 2. second 3. third
0.5 + 0.25 = 0.75 as shown
COVID-19 and F-16 and A4 and 3D
user_name and @mention and #tag42 and a@b
don't say we've lost the e-mail of foo_bar here
see host.example.com or www.example.org for more
phone phone foo_bar and don't host.example.com again
the well-known e-mail, the phone and the so-called card
it's o'clock_now at the end-of-day and a.b.c too
l'an d'un c'est qu'il n'a pas d'e-mail
write foo_bar don't host.example.com don't e-mail at once
e-mail [email|jo.smith [at] example [dot] net] don't wait
either/or and/or his/her yes/no n/a
"""
